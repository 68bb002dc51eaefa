"""The sentence row. Columns of a token may be left out where no operator asks for them. Names and their order are fixed values of the file format."""

DEP = "struct<headid:int,headsubid:int,deprel:string>"
MISC = "struct<key:string,val:string>"
TOKEN = (
    "struct<kind:string,id:int,subid:int,form:string,lemma:string,upos:string,xpos:string,feats:map<string,string>,"
    f"head:int,deprel:string,deps:array<{DEP}>,misc:array<{MISC}>>"
)
SENTENCE = (
    "source string, sent_no long, sent_id string, text string, newdoc string, newpar string, translit string, "
    f"translations map<string,string>, comments array<string>, words array<{TOKEN}>, empties array<{TOKEN}>, mwts array<{TOKEN}>, errors array<string>"
)
WORD, MWT, EMPTY = "WORD", "MWT", "EMPTY"
EMPTY_CELL = "_"
#: Standard columns in file order.
COLUMNS = ("ID", "FORM", "LEMMA", "UPOS", "XPOS", "FEATS", "HEAD", "DEPREL", "DEPS", "MISC")
