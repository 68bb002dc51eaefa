"""Text of sentences and of columns: surface forms, offsets, feature, MISC and enhanced-dependency strings, transliteration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .let import let


def spaces(misc: Column) -> Column:
    """What stands after a token: nothing for SpaceAfter=No, SpacesAfter with \\s, \\t, \\n decoded, else one blank."""
    get = lambda key: F.get(F.transform(F.filter(misc, lambda m: m["key"] == key), lambda m: m["val"]), F.lit(0))
    written = F.replace(F.replace(F.replace(get("SpacesAfter"), F.lit(r"\s"), F.lit(" ")), F.lit(r"\t"), F.lit("\t")), F.lit(r"\n"), F.lit("\n"))
    return F.when(get("SpaceAfter") == "No", "").otherwise(F.coalesce(written, F.lit(" ")))


def _covering(w: Column) -> Column:
    """The multiword token over a word; null if there is none."""
    return F.get(F.filter("mwts", lambda x: w["id"].between(x["id"], x["subid"])), F.lit(0))


def surface() -> Column:
    """The sentence's text from its forms: a multiword token stands for the words it covers; trailing blanks go."""
    def piece(w: Column) -> Column:
        m = _covering(w)
        own = F.concat(w["form"], spaces(w["misc"]))
        whole = F.concat(m["form"], spaces(m["misc"]))
        return F.when(m.isNull(), own).when(m["id"] == w["id"], whole).otherwise("")

    return F.rtrim(F.array_join(F.transform("words", piece), ""))


def surface_pieces() -> Column:
    """id -> form and what stands after it, of every word."""
    return F.map_from_entries(F.transform("words", lambda w: F.struct(w["id"], F.concat(w["form"], spaces(w["misc"])))))


def offsets() -> Column:
    """(id, start, end) of each word in the text that `surface` gives, from 0: what stands after a token counts as MISC says, and words that a multiword
    token covers have its place. A running sum inside the sentence."""
    def part(w: Column) -> Column:  # the word's number, the token's length, and how far the text goes on with it
        m = _covering(w)
        size = lambda t: F.length(t["form"])
        on = lambda t: size(t) + F.length(spaces(t["misc"]))
        return F.struct(
            w["id"].alias("id"), F.coalesce(size(m), size(w)).alias("size"), F.when(m.isNull(), on(w)).when(m["id"] == w["id"], on(m)).otherwise(0).alias("on"),
            F.coalesce(m["id"] < w["id"], F.lit(False)).alias("inside"),
        )

    none = F.array().cast("array<struct<id:int,start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("last"), none.alias("out"))

    def step(a: Column, p: Column) -> Column:
        here = F.when(p["inside"], a["last"]).otherwise(a["at"])
        return F.struct((a["at"] + p["on"]).alias("at"), here.alias("last"), F.concat(a["out"], F.array(F.struct(p["id"].alias("id"), here.alias("start"), (here + p["size"]).alias("end")))).alias("out"))

    return F.aggregate(F.transform("words", part), start, step, lambda a: a["out"])


def first_difference(a: Column, b: Column) -> Column:
    """Position (from 0) of the first character in which two texts differ; -1 if one begins the other."""
    def differ(a: Column, b: Column) -> Column:
        n = F.least(F.length(a), F.length(b))
        at = F.get(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))), F.lit(0))
        return F.when(n == 0, -1).otherwise(F.coalesce(at - 1, F.lit(-1)))

    return let(a, b, then=differ)


def _halves(text: Column) -> Column:
    """A=B|C as [A, B] and [C], without empty parts and _. Splitting at one character takes no regular expression."""
    parts = F.filter(F.split(F.replace(text, F.lit("\n"), F.lit("|")), r"\|"), lambda x: (x != "") & (x != "_"))
    return F.transform(parts, lambda x: F.split(x, "=", 2))


def feats_of(text: Column) -> Column:
    """A=B|C=D as a map; the later of two equal names (whatever their case) wins; no "=" gives an empty value."""
    half = lambda p, i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
    parts = F.transform(_halves(text), lambda p: F.struct(half(p, 0).alias("key"), half(p, 1).alias("value")))
    def last(parts: Column) -> Column:
        later = lambda p, i: F.exists(F.slice(parts, i + 2, F.greatest(F.size(parts) - i - 1, F.lit(0))), lambda q: F.lower(q["key"]) == F.lower(p["key"]))
        names = F.array_distinct(F.transform(parts, lambda p: F.lower(p["key"])))
        return F.when(F.size(names) == F.size(parts), parts).otherwise(F.filter(parts, lambda p, i: ~later(p, i)))  # each is looked for among the later ones only if two are equal

    return F.map_from_entries(let(parts, then=last))


def feats_text(feats: Column) -> Column:
    """The map as A=B|C=D, in order of name whatever its case; _ if empty."""
    low = lambda e: F.struct(F.lower(e["key"]).alias("k"), e["key"].alias("key"), e["value"].alias("value"))
    joined = lambda pairs: F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    # one feature has nothing to be sorted by
    return F.when(F.size(feats) > 1, joined(F.array_sort(F.transform(F.map_entries(feats), low)))).when(F.size(feats) == 1, joined(F.map_entries(feats))).otherwise("_")


def misc_of(text: Column) -> Column:
    """A=B|C as pairs in order; a key without "=" or with nothing after it has a null value."""
    return F.transform(_halves(text), lambda p: F.struct(F.coalesce(F.get(p, F.lit(0)), F.lit("")).alias("key"), F.nullif(F.get(p, F.lit(1)), F.lit("")).alias("val")))


def misc_text(misc: Column) -> Column:
    pairs = F.transform(misc, lambda m: F.concat(m["key"], F.coalesce(F.concat(F.lit("="), m["val"]), F.lit(""))))
    return F.when(F.size(misc) > 0, F.array_join(pairs, "|")).otherwise("_")


def deps_of(text: Column) -> Column:
    """h:rel|h.s:rel as structs; the entry 0 alone is skipped."""
    parts = F.filter(F.split(text, r"\|"), lambda x: (x != "") & (x != "_") & (x != "0"))
    head = lambda x: F.substring_index(x, ":", 1)
    return F.transform(parts, lambda x: F.struct(
        F.substring_index(head(x), ".", 1).try_cast("int").alias("headid"), F.when(F.instr(head(x), ".") > 0, F.substring_index(head(x), ".", -1).try_cast("int")).otherwise(-1).alias("headsubid"),
        F.when(F.instr(x, ":") > 0, F.substring(x, F.instr(x, ":") + 1, F.length(x))).otherwise("").alias("deprel"),
    ))


def deps_text(deps: Column) -> Column:
    one = lambda d: F.concat(d["headid"].cast("string"), F.when(d["headsubid"] >= 0, F.concat(F.lit("."), d["headsubid"].cast("string"))).otherwise(""), F.lit(":"), d["deprel"])
    return F.when(F.size(deps) > 0, F.array_join(F.transform(deps, one), "|")).otherwise("_")


def subphrase(labels: list[str]) -> Column:
    """Forms from the first to the last word that has one of these labels."""
    ids = F.transform(F.filter("words", lambda w: w["deprel"].isin(labels)), lambda w: w["id"])
    inside = lambda a, z: F.array_join(F.transform(F.filter("words", lambda w: w["id"].between(a, z)), lambda w: w["form"]), " ")
    return let(F.array_min(ids), F.array_max(ids), then=inside)


# Scientific transliteration of Cyrillic (ISO 9), letter by letter. Fixed values of that standard.
CYRILLIC = ("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "abvgdeëžzijklmnoprstufhcčšŝʺyʹèûâ")


def transliterate(text: Column, table: tuple[str, str] = CYRILLIC) -> Column:
    """Letter for letter by a table of small letters; capitals follow."""
    small, to = table
    pairs = [(a, b) for a, b in zip(small, to, strict=True)]
    pairs += [(a.upper(), b.upper()) for a, b in pairs if a.upper() != a]
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def by_rules(text: Column, rules: list[tuple[str, str]] | str, tables: dict[str, list[tuple[str, str]] | str] | None = None) -> Column:
    """A text with replacements (pattern, replacement) made one after another, each in what the one before left. A blank stands behind the text meanwhile, so rules can
    ask for the end of a word. A name stands for its list in `tables`, or for another name there."""
    while isinstance(rules, str):
        rules = (tables or {})[rules]
    out = F.concat(text, F.lit(" "))
    for pattern, to in rules:
        out = F.regexp_replace(out, pattern, to)
    return F.rtrim(out)


def with_translit(sents: DataFrame, rules: list[tuple[str, str]] | str, tables: dict | None = None) -> DataFrame:
    """sents whose words have Translit and LTranslit in MISC, where they differ from form and lemma, and whose `translit` is that of the text."""
    def one(w: Column) -> Column:
        names = {"Translit": w["form"], "LTranslit": w["lemma"]}
        kept = F.filter(w["misc"], lambda m: ~m["key"].isin(list(names)))
        new = F.array(*(F.struct(F.lit(n).alias("key"), by_rules(x, rules, tables).alias("val")) for n, x in names.items()))
        old = F.create_map(*(y for n, x in names.items() for y in (F.lit(n), x)))
        return w.withField("misc", F.concat(kept, F.filter(new, lambda m: m["val"] != F.try_element_at(old, m["key"]))))

    return sents.withColumn("words", F.transform("words", one)).withColumn("translit", by_rules(F.col("text"), rules, tables))
