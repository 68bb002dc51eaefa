"""Registered queries: each runs an operator over a treebank view of the driver's tables, with the same query in SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import conditions as c
from .functions import text as tx
from .functions import values as v
from .operators import corpus, edit, grew, history, search, similar, stats, trees, validate
from .operators.tokens import Tokens
from .registry import ALL, CONDITIONS, ORACLES, PATTERNS, QUERIES, SYS, TOK, query, scratch
from .sources import conllu, export, sdparse, stored, views

def tokens(name: str, cond: c.Cond, where: str) -> None:
    """A condition over the words of the orders view; `where` is the same over rows t of tok."""
    CONDITIONS[name] = cond
    query(name, lambda s, d: c.tokens_where(views.orders(s, d), cond, "sent").select("sent", "id"), f"{TOK} SELECT sent, id FROM tok t WHERE {where}")


HEAD = "EXISTS (SELECT 1 FROM tok h WHERE h.sent = t.sent AND h.id = t.head AND {})"
CHILD = "EXISTS (SELECT 1 FROM tok c WHERE c.sent = t.sent AND c.head = t.id AND {})"
PREC = "EXISTS (SELECT 1 FROM tok p WHERE p.sent = t.sent AND p.id = t.id - 1 AND {})"
NEXT = "EXISTS (SELECT 1 FROM tok x WHERE x.sent = t.sent AND x.id = t.id + 1 AND {})"

# atoms
tokens("cond_upos", c.upos("R"), "t.upos = 'R'")
tokens("cond_xpos", c.xpos("O|Q"), "t.xpos = 'O'")
tokens("cond_lemma", c.lemma("S.*|ECON.*Y"), "regexp_full_match(t.lemma, 'S.*|ECON.*Y')")
tokens("cond_form", c.form(".* ring"), "regexp_full_match(t.form, '.* ring')")
tokens("cond_deprel", c.deprel("dep[12]"), "t.deprel IN ('dep1', 'dep2')")
tokens("cond_feat", c.feat("size", "2"), "t.size = '2'")
tokens("cond_feat_any", c.feat("Disc"), "t.disc IS NOT NULL")
tokens("cond_misc", c.misc("Line", "[3-5]"), "t.line BETWEEN 3 AND 5")
tokens("cond_misc_absent", ~c.misc("Gloss"), "t.psize % 2 = 1")
tokens("cond_id", c.token_id(3), "t.id = 3")
tokens("cond_headid", c.head_id(1), "t.head = 1")
tokens("cond_headid_rel", c.head_id(-2, relative=True), "t.head = t.id - 2")
tokens("cond_eud_abs", c.eud("ext", 2), "t.id = 4")
tokens("cond_eud_rel", c.eud("dep1", -1, relative=True), "t.head = t.id - 1 AND t.deprel = 'dep1'")
tokens("cond_and_or_not", c.upos("R") & (c.xpos("O") | ~c.feat("Disc")), "t.upos = 'R' AND (t.xpos = 'O' OR t.disc IS NULL)")
tokens("cond_val_eq", c.same(c.value("upos"), c.of_head(c.value("upos"))), HEAD.format("h.upos = t.upos"))
tokens("cond_val_compat", c.compatible(c.feat_value("Disc"), c.of_head(c.value("lemma"))), f"t.disc IS NULL OR NOT {HEAD.format('true')}")
tokens("cond_getters", c.same(c.feat_value("Size"), c.of_next(c.feat_value("Size"))), NEXT.format("x.size = t.size"))


def _kinds(name: str, cond: c.Cond, kind: str) -> None:
    query(name, lambda s, d: c.tokens_where(views.orders(s, d), cond, "sent", kinds=("words", "mwts", "empties")).select("sent", "id"), f"{ALL} SELECT sent, id FROM alltok WHERE kind = '{kind}'")


_kinds("cond_mwt", c.mwt(2), "MWT")
_kinds("cond_ismwt", c.is_mwt, "MWT")
_kinds("cond_isempty", c.is_empty, "EMPTY")

# navigation
tokens("nav_head", c.upos("R") & c.head(c.upos("N")), "t.upos = 'R' AND " + HEAD.format("h.upos = 'N'"))
tokens("nav_child", c.child(c.upos("R")), CHILD.format("c.upos = 'R'"))
tokens("nav_not_child", ~c.child(c.upos("R")), "NOT " + CHILD.format("c.upos = 'R'"))
tokens("nav_prec", c.prec(c.upos("A") & c.xpos("O")), PREC.format("p.upos = 'A' AND p.xpos = 'O'"))
tokens("nav_next", c.next_(c.lemma("PROMO")), NEXT.format("x.lemma = 'PROMO'"))
tokens(
    "nav_nested",
    c.head(c.next_(c.upos("A"))) & ~c.child(c.head(c.xpos("F"))),
    "EXISTS (SELECT 1 FROM tok h JOIN tok x ON x.sent = h.sent AND x.id = h.id + 1 WHERE h.sent = t.sent AND h.id = t.head AND x.upos = 'A') AND NOT (t.xpos = 'F' AND " + CHILD.format("true") + ")",
)
tokens("nav_get_child", c.same(c.value("lemma"), c.of_child(c.value("lemma"))), CHILD.format("c.lemma = t.lemma"))
tokens("nav_get_prec", c.same(c.value("xpos"), c.of_prec(c.value("xpos"))), PREC.format("p.xpos = t.xpos"))


def _eud_join(s: SparkSession, d: str) -> DataFrame:
    words = views.orders(s, d).select("sent", F.inline("words"))
    edges = words.select("sent", "id", F.explode("deps").alias("e")).select("sent", "id", F.col("e.headid").alias("headid"), F.col("e.deprel").alias("rel"))
    heads = words.select("sent", F.col("id").alias("headid"), F.col("upos").alias("head_upos"))
    return edges.join(heads, ["sent", "headid"]).groupBy("rel", "head_upos").agg(F.count("*").alias("n"))


query(
    "eud_join",
    _eud_join,
    f"""{TOK}, e AS (SELECT sent, id, head AS headid, deprel AS rel FROM tok UNION ALL SELECT sent, id, id - 2, 'ext' FROM tok WHERE id > 2)
   SELECT e.rel AS rel, h.upos AS head_upos, count(*) AS n FROM e JOIN tok h ON h.sent = e.sent AND h.id = e.headid GROUP BY ALL""",
)
query(
    "mwt_join",
    lambda s, d: (views.orders(s, d)
    .select("sent", F.explode(F.filter("words", lambda w: F.exists("mwts", lambda m: w["id"].between(m["id"], m["subid"])))).alias("w"))
    .select("sent", "w.id")),
    f"{TOK} SELECT sent, id FROM tok WHERE sent % 3 = 0 AND n > 2 AND id <= 2",
)
query(
    "filter_corpus",
    lambda s, d: search.by_text_or_tag(views.orders(s, d), "red .*widget").select("sent"),
    f"""{TOK} SELECT sent FROM (SELECT sent, string_agg(form, ' ' ORDER BY id) AS txt FROM tok GROUP BY sent) WHERE regexp_matches(txt, 'red .*widget')""",
)
query(
    "filter_sid",
    lambda s, d: search.by_exact_id(views.orders(s, d), "77", "sent").select("sent", F.size("words").cast("long").alias("n")),
    f"{TOK} SELECT sent, count(*) AS n FROM tok WHERE sent = 77 GROUP BY sent",
)

# tables of tokens: the orders of a thousand keys each as one long sentence


def _long(s: SparkSession, d: str) -> Tokens:
    """The table is written once: every navigation reads its own columns of it again."""
    sents = views.orders(s, d, per=1000).select("grp", "sent", "words", "mwts", "empties")
    return Tokens(stored.stored(corpus.merged_tokens(sents, "grp", "sent", bounded=True).drop("sent"), scratch(s)), "grp")


LONG = TOK + """, long AS (SELECT sent // 1000 AS grp, row_number() OVER (PARTITION BY sent // 1000 ORDER BY sent, id) AS gid, * FROM tok),
 t AS (SELECT l.*, CASE WHEN l.head = 0 THEN 0 ELSE l.gid - l.id + l.head END AS ghead FROM long l)"""
query(
    "table_navigation",
    lambda s, d: _long(s, d).where(c.head(c.next_(c.upos("A"))) & ~c.child(c.head(c.xpos("F"))) & ~c.prec(c.lemma("PROMO.*"))).where("kind = 'WORD'").select("grp", "id"),
    f"""{LONG} SELECT t.grp AS grp, t.gid AS id FROM t WHERE EXISTS (SELECT 1 FROM t h JOIN t x ON x.grp = h.grp AND x.gid = h.gid + 1 WHERE h.grp = t.grp AND h.gid = t.ghead AND x.upos = 'A')
   AND NOT (t.xpos = 'F' AND EXISTS (SELECT 1 FROM t k WHERE k.grp = t.grp AND k.ghead = t.gid))
   AND NOT EXISTS (SELECT 1 FROM t p WHERE p.grp = t.grp AND p.gid = t.gid - 1 AND starts_with(p.lemma, 'PROMO'))""",
)
query(
    "table_values",
    lambda s, d: _long(s, d).where(c.same(c.value("lemma"), c.of_child(c.value("lemma"))) | ~c.compatible(c.feat_value("Disc"), c.of_prec(c.feat_value("Disc")))).where("kind = 'WORD'").select("grp", "id"),
    f"{LONG} SELECT grp, gid AS id FROM t WHERE EXISTS (SELECT 1 FROM t k WHERE k.grp = t.grp AND k.ghead = t.gid AND k.lemma = t.lemma)",
)
query(
    "table_pattern",
    lambda s, d: (_long(s, d).match(grew.Pattern({"A": c.upos("N"), "C": c.xpos("O")}, [("A", "B"), ("B", "C")], order=[("A", "C", False)], without=[[("C", c.upos("R"), ["dep1"])], [("B", "X"), grew.Is("X", c.lemma("PROMO.*"))]]))
    .select("grp", F.col("A.id").alias("a"), F.col("B.id").alias("b"), F.col("C.id").alias("c"))),
    f"""{LONG} SELECT a.grp AS grp, a.gid AS a, b.gid AS b, k.gid AS c FROM t a JOIN t b ON b.grp = a.grp AND b.ghead = a.gid JOIN t k ON k.grp = a.grp AND k.ghead = b.gid
   WHERE a.upos = 'N' AND k.xpos = 'O' AND a.gid < k.gid AND NOT EXISTS (SELECT 1 FROM t x WHERE x.grp = k.grp AND x.ghead = k.gid AND x.upos = 'R' AND x.deprel = 'dep1')
   AND NOT EXISTS (SELECT 1 FROM t x WHERE x.grp = b.grp AND x.ghead = b.gid AND starts_with(x.lemma, 'PROMO'))""",
)

# graph patterns


def pattern(name: str, p: grew.Pattern, sql: str) -> None:
    """Bindings of a pattern: the sentence and the id of each node, in order of name."""
    PATTERNS[name] = p
    names = list(p.nodes)
    query(name, lambda s, d: grew.match(views.orders(s, d), p, "sent").select("sent", *(F.col(n)["id"].alias(n.lower()) for n in names)), f"{TOK} {sql}")


pattern(
    "grew_match",
    grew.Pattern({"H": c.upos("N"), "D": c.upos("R")}, [("H", "D")]),
    """SELECT h.sent AS sent, h.id AS h, d.id AS d FROM tok h JOIN tok d ON d.sent = h.sent AND d.head = h.id WHERE h.upos = 'N' AND d.upos = 'R'""",
)
pattern(
    "grew_node",
    grew.Pattern({"N": c.upos(["A", "R"]) & c.feat("Size", "4") & ~c.feat("Disc")}),
    "SELECT sent, id AS n FROM tok WHERE upos IN ('A', 'R') AND size = '4' AND disc IS NULL",
)
pattern("grew_node_neg", grew.Pattern({"N": ~c.upos("A") & c.feat("Size") & ~c.feat("Size", "4")}), "SELECT sent, id AS n FROM tok WHERE upos <> 'A' AND size <> '4'")
pattern(
    "grew_edge_label",
    grew.Pattern({}, [("A", "B", ["dep1", "dep3"])]),
    """SELECT a.sent AS sent, a.id AS a, b.id AS b FROM tok a JOIN tok b ON b.sent = a.sent AND b.head = a.id WHERE b.deprel IN ('dep1', 'dep3')""",
)
pattern(
    "grew_edge_not",
    grew.Pattern({"A": c.upos("A")}, [("A", "B", ["dep1", "dep3"], True)]),
    """SELECT a.sent AS sent, a.id AS a, b.id AS b FROM tok a JOIN tok b ON b.sent = a.sent AND b.head = a.id
   WHERE a.upos = 'A' AND b.deprel NOT IN ('dep1', 'dep3')""",
)
pattern(
    "grew_edge_chain",
    grew.Pattern({"A": c.upos("N"), "C": c.xpos("O")}, [("A", "B"), ("B", "C", ["dep2"])]),
    """SELECT a.sent AS sent, a.id AS a, b.id AS b, x.id AS c FROM tok a JOIN tok b ON b.sent = a.sent AND b.head = a.id
   JOIN tok x ON x.sent = a.sent AND x.head = b.id WHERE a.upos = 'N' AND x.xpos = 'O' AND x.deprel = 'dep2'""",
)
pattern(
    "grew_order",
    grew.Pattern({"A": c.upos("A"), "B": c.upos("R")}, order=[("A", "B", True)]),
    """SELECT a.sent AS sent, a.id AS a, b.id AS b FROM tok a JOIN tok b ON b.sent = a.sent AND b.id = a.id + 1 WHERE a.upos = 'A' AND b.upos = 'R'""",
)
pattern(
    "grew_order_before",
    grew.Pattern({"A": c.feat("Size", "1"), "B": c.feat("Size", "3")}, order=[("A", "B", False)]),
    """SELECT a.sent AS sent, a.id AS a, b.id AS b FROM tok a JOIN tok b ON b.sent = a.sent AND b.id > a.id WHERE a.size = '1' AND b.size = '3'""",
)
pattern(
    "grew_attr_cmp",
    grew.Pattern({"A": c.upos("N")}, [("A", "B")], agree=[("A", c.value("lemma"), "B", c.value("lemma"), True)]),
    """SELECT a.sent AS sent, a.id AS a, b.id AS b FROM tok a JOIN tok b ON b.sent = a.sent AND b.head = a.id WHERE a.upos = 'N' AND a.lemma = b.lemma""",
)
pattern(
    "grew_without_edge",
    grew.Pattern({"V": c.upos("N")}, without=[[("V", c.upos("R"), ["dep1"])]]),
    "SELECT sent, id AS v FROM tok t WHERE upos = 'N' AND NOT " + CHILD.format("c.upos = 'R' AND c.deprel = 'dep1'"),
)
pattern(
    "grew_inject",
    grew.Pattern({"A": c.lemma("PROMO"), "B": c.lemma("PROMO")}),
    """SELECT a.sent AS sent, a.id AS a, b.id AS b FROM tok a JOIN tok b ON b.sent = a.sent AND b.id <> a.id WHERE a.lemma = 'PROMO' AND b.lemma = 'PROMO'""",
)
pattern("grew_global_tree", grew.Pattern({"R": c.deprel("root")}, tests=[grew.tree()]), "SELECT sent, id AS r FROM tok WHERE deprel = 'root'")
query(
    "grew_output",
    lambda s, d: (grew.match(views.orders(s, d), grew.Pattern({"X": c.upos("R"), "B": c.upos("N")}, [("X", "B")]), "sent")
    .select("sent", F.array_join(F.transform("ids", lambda i: i.cast("string")), "-").alias("ids"))),
    f"""{TOK} SELECT h.sent AS sent, least(h.id, d.id) || '-' || greatest(h.id, d.id) AS ids FROM tok h JOIN tok d ON d.sent = h.sent AND d.head = h.id
   WHERE h.upos = 'R' AND d.upos = 'N'""",
)
LINK = grew.Pattern({"H": c.upos("N"), "D": c.upos("R")}, [("H", "D")])
query(
    "grew_count",
    lambda s, d: grew.counted(views.orders(s, d), LINK, "sent"),
    f"""{TOK} SELECT h.sent AS sent, count(*) AS n FROM tok h JOIN tok d ON d.sent = h.sent AND d.head = h.id WHERE h.upos = 'N' AND d.upos = 'R'
   GROUP BY h.sent""",
)
query(
    "grew_count_tree",
    lambda s, d: grew.counted(views.orders(s, d), grew.Pattern({"A": c.upos(["N", "A"])}, [("A", "B"), ("A", "C"), ("C", "E"), ("C", "G", ["dep1", "dep2"])]), "sent"),
    f"""{TOK} SELECT a.sent AS sent, count(*) AS n FROM tok a JOIN tok b ON b.sent = a.sent AND b.head = a.id JOIN tok c ON c.sent = a.sent AND c.head = a.id AND c.id <> b.id
   JOIN tok e ON e.sent = a.sent AND e.head = c.id JOIN tok g ON g.sent = a.sent AND g.head = c.id AND g.id <> e.id AND g.deprel IN ('dep1', 'dep2')
   WHERE a.upos IN ('N', 'A') GROUP BY a.sent""",
)
query(
    "grew_count_order",
    lambda s, d: grew.counted(views.orders(s, d), grew.Pattern({"A": c.upos("A"), "C": c.xpos("O")}, [("B", "C")], order=[("A", "C", False)], without=[[("A", "X")]]), "sent"),
    f"""{TOK}, node AS (SELECT sent, id FROM tok UNION ALL SELECT DISTINCT sent, 0 FROM tok)
   SELECT a.sent AS sent, count(*) AS n FROM tok a JOIN tok k ON k.sent = a.sent AND k.id > a.id JOIN node b ON b.sent = k.sent AND b.id = k.head AND b.id <> a.id
   WHERE a.upos = 'A' AND k.xpos = 'O' AND NOT EXISTS (SELECT 1 FROM tok x WHERE x.sent = a.sent AND x.head = a.id) GROUP BY a.sent""",
)
query(
    "grew_filter",
    lambda s, d: grew.matching(views.orders(s, d), LINK, "sent"),
    f"""{TOK} SELECT DISTINCT h.sent AS sent FROM tok h JOIN tok d ON d.sent = h.sent AND d.head = h.id WHERE h.upos = 'N' AND d.upos = 'R'""",
)

# other searches
query(
    "find_sentid",
    lambda s, d: search.by_id(views.orders(s, d), "^1.*7$", "sent").select("sent"),
    f"{TOK} SELECT DISTINCT sent FROM tok WHERE regexp_matches(CAST(sent AS VARCHAR), '^1.*7$')",
)


def _spaced(s: SparkSession, d: str) -> DataFrame:
    """The orders view, where of even orders every third word from the first on has nothing behind it."""
    no = F.array(F.struct(F.lit("SpaceAfter").alias("key"), F.lit("No").alias("val")))
    joined = lambda w: F.when((F.col("sent") % 2 == 0) & (w["id"] % 3 == 1), w.withField("misc", F.concat(w["misc"], no))).otherwise(w)
    return views.settled(views.orders(s, d).withColumn("words", F.transform("words", joined)), "words")


#: Its words in the surface text: what stands for each, the gap behind, where it begins and ends.
SPACED = TOK + """, f AS (SELECT *, sent % 3 = 0 AND n > 2 AND id <= 2 AS inside, lead(form) OVER (PARTITION BY sent ORDER BY id) AS after_ FROM tok),
 p AS (SELECT sent, id, CASE WHEN inside AND id = 1 THEN form || after_ WHEN inside THEN '' ELSE form END AS piece,
   CASE WHEN inside AND id = 1 THEN ' ' WHEN inside OR (sent % 2 = 0 AND id % 3 = 1) THEN '' ELSE ' ' END AS gap, inside FROM f),
 o AS (SELECT *, CAST(coalesce(sum(length(piece || gap)) OVER (PARTITION BY sent ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM p),
 off AS (SELECT o.sent, o.id, CASE WHEN o.inside THEN 0 ELSE o.at END AS start, CASE WHEN o.inside THEN length(one.piece) ELSE o.at + length(o.piece) END AS stop
   FROM o JOIN o one ON one.sent = o.sent AND one.id = 1)"""
query(
    "find_word",
    lambda s, d: (search.surface_hits(_spaced(s, d), "t r", "sent")
    .select("sent", F.col("at").cast("long").alias("at"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))),
    f"""{SPACED}, txt AS (SELECT sent, rtrim(string_agg(piece || gap, '' ORDER BY id)) AS txt FROM p GROUP BY sent),
 pos AS (SELECT sent, i AS at FROM txt, LATERAL unnest(range(0, length(txt) - 2)) x(i) WHERE substr(txt, i + 1, 3) = 't r')
SELECT o.sent AS sent, pos.at AS at, string_agg(CAST(o.id AS VARCHAR), ',' ORDER BY o.id) AS ids FROM off o JOIN pos ON o.sent = pos.sent
   WHERE o.start < pos.at + 3 AND o.stop > pos.at GROUP BY o.sent, pos.at""",
)
query(
    "find_seq",
    lambda s, d: search.sequence_of(views.orders(s, d), [c.upos("A"), c.upos("N"), c.upos("R")], "sent"),
    f"""{TOK} SELECT a.sent AS sent, a.id AS start FROM tok a JOIN tok b ON b.sent = a.sent AND b.id = a.id + 1
   JOIN tok x ON x.sent = a.sent AND x.id = a.id + 2 WHERE a.upos = 'A' AND b.upos = 'N' AND x.upos = 'R'""",
)
query(
    "find_multi",
    lambda s, d: search.sequence_of(views.orders(s, d), [c.upos("A") & c.xpos("O"), c.lemma("PROMO|SMALL") & c.feat("Size", "[1-3]")], "sent"),
    f"""{TOK} SELECT a.sent AS sent, a.id AS start FROM tok a JOIN tok b ON b.sent = a.sent AND b.id = a.id + 1
   WHERE a.upos = 'A' AND a.xpos = 'O' AND b.lemma IN ('PROMO', 'SMALL') AND b.size BETWEEN '1' AND '3'""",
)
tokens(
    "find_deprel",
    search.deprel_path("dep1", (">", "dep2"), ("<", "dep3")),
    """t.deprel = 'dep1' AND EXISTS (SELECT 1 FROM tok h JOIN tok k ON k.sent = h.sent AND k.head = h.id
   WHERE h.sent = t.sent AND h.id = t.head AND h.deprel = 'dep2' AND k.deprel = 'dep3')""",
)
tokens(
    "deprel_path",
    search.deprel_path("dep1", ("=", "dep2")),
    """t.deprel = 'dep1' AND t.head > 0 AND EXISTS (SELECT 1 FROM tok k WHERE k.sent = t.sent AND k.head = t.head AND k.id <> t.id AND k.deprel = 'dep2')""",
)
E_ = search.Example
tokens(
    "find_subtree",
    search.example(E_(c.upos("N"), [E_(c.upos("R") & c.deprel("dep1")), E_(c.xpos("O"), [E_(c.Cond(lambda t: F.lit(True)))])])),
    "t.upos = 'N' AND " + CHILD.format("c.upos = 'R' AND c.deprel = 'dep1'") + " AND " + CHILD.format("c.xpos = 'O' AND EXISTS (SELECT 1 FROM tok g WHERE g.sent = c.sent AND g.head = c.id)"),
)
query(
    "find_subtree_words",
    lambda s, d: (search.hits(views.orders(s, d), search.example_words(E_(c.upos("N"), [E_(c.upos("R") & c.deprel("dep1")), E_(c.xpos("O"), [E_(c.Cond(lambda t: F.lit(True)))])])), "sent")
    .select("sent", "id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))),
    f"""{TOK}, b AS (SELECT t.sent AS sent, t.id AS id, k.id AS k, o.id AS o, g.id AS g FROM tok t JOIN tok k ON k.sent = t.sent AND k.head = t.id AND k.upos = 'R' AND k.deprel = 'dep1'
   JOIN tok o ON o.sent = t.sent AND o.head = t.id AND o.xpos = 'O' JOIN tok g ON g.sent = t.sent AND g.head = o.id WHERE t.upos = 'N'),
 w AS (SELECT DISTINCT sent, id, unnest([id, k, o, g]) AS w FROM b)
 SELECT sent, id, string_agg(CAST(w AS VARCHAR), ',' ORDER BY w) AS ids FROM w GROUP BY sent, id""",
)
query(
    "find_deprel_words",
    lambda s, d: (search.hits(views.orders(s, d), search.path_words("dep1", (">", "dep2"), ("<", "dep3")), "sent")
    .select("sent", "id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))),
    f"""{TOK}, w AS (SELECT DISTINCT t.sent AS sent, t.id AS id, unnest([t.id, h.id, k.id]) AS w FROM tok t JOIN tok h ON h.sent = t.sent AND h.id = t.head AND h.deprel = 'dep2'
   JOIN tok k ON k.sent = h.sent AND k.head = h.id AND k.deprel = 'dep3' WHERE t.deprel = 'dep1')
 SELECT sent, id, string_agg(CAST(w AS VARCHAR), ',' ORDER BY w) AS ids FROM w GROUP BY sent, id""",
)
query(
    "find_expression",
    lambda s, d: search.first_token(views.orders(s, d), c.is_empty | c.upos("R"), "sent").select("sent", "kind", "id"),
    f"""{ALL} SELECT sent, kind, id
   FROM (SELECT a.sent, a.kind, a.id, row_number() OVER (PARTITION BY a.sent ORDER BY CASE a.kind WHEN 'WORD' THEN 0 ELSE 1 END, a.id) AS k
   FROM alltok a LEFT JOIN tok t ON t.sent = a.sent AND t.id = a.id WHERE a.kind = 'EMPTY' OR (a.kind = 'WORD' AND t.upos = 'R')) WHERE k = 1""",
)
query(
    "find_highlight",
    lambda s, d: (edit.highlight(views.orders(s, d), c.upos("R") & c.feat("Disc"))
    .where(F.size("highlighted") > 0)
    .select("sent", F.size("highlighted").cast("long").alias("n"))),
    f"{TOK} SELECT sent, count(*) AS n FROM tok WHERE upos = 'R' AND disc = 'Yes' GROUP BY sent",
)
query(
    "nav_cursor",
    lambda s, d: search.after(c.sentences_where(views.orders(s, d), c.upos("R") & c.head(c.upos("N"))), "sent", 100).select("sent"),
    f"{TOK} SELECT min(t.sent) AS sent FROM tok t WHERE t.sent > 100 AND t.upos = 'R' AND " + HEAD.format("h.upos = 'N'"),
)
query(
    "find_comment",
    lambda s, d: (search.by_comment(views.read(s, d, "conversations")
    .select("conv_id", "turn", F.array(F.concat(F.lit("role = "), "role")).alias("comments")), "assist")
    .select("conv_id", "turn")),
    "SELECT conv_id, turn FROM conversations WHERE contains(role, 'assist')",
)

# order, folds, merging
query("shuffle", lambda s, d: corpus.shuffled(views.orders(s, d), 7, "sent").select("sent"), f"{TOK} SELECT DISTINCT sent FROM tok")
query(
    "crossval",
    lambda s, d: corpus.folds(views.orders(s, d), "sent", 5).groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum("sent").alias("sum_sent")),
    f"""{TOK}, u AS (SELECT DISTINCT sent FROM tok), f AS (SELECT CAST(range AS INTEGER) AS fold FROM range(5))
   SELECT fold, CASE WHEN (sent + fold) % 5 = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS n, CAST(sum(sent) AS BIGINT) AS sum_sent FROM u, f
   GROUP BY ALL""",
)
query(
    "sort_feats",
    lambda s, d: views.orders(s, d).select("sent", F.inline("words")).select("sent", "id", tx.feats_text(F.col("feats")).alias("feats")),
    f"{TOK} SELECT sent, id, CASE WHEN disc IS NULL THEN '' ELSE 'Disc=Yes|' END || 'Size=' || size AS feats FROM tok",
)

# statistics
query(
    "stats_counts",
    lambda s, d: stats.counts(views.orders(s, d)),
    f"""{TOK}, u AS (SELECT sent, count(*) AS n FROM tok GROUP BY sent)
   SELECT count(*) AS sentences, CAST(sum(n) AS BIGINT) AS syntactic_words, CAST(sum(CASE WHEN sent % 3 = 0 AND n > 2 THEN 1 ELSE 0 END) AS BIGINT) AS mwts, CAST(sum(CASE WHEN sent % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_words, CAST(sum(n - CASE WHEN sent % 3 = 0 AND n > 2 THEN 1 ELSE 0 END) AS BIGINT) AS surface_words
   FROM u""",
)
query("stats_upos", lambda s, d: stats.by_field(views.orders(s, d), "upos"), f"{TOK} SELECT upos, count(*) AS n FROM tok GROUP BY upos")
query("stats_deprel", lambda s, d: stats.by_field(views.orders(s, d), "deprel"), f"{TOK} SELECT deprel, count(*) AS n FROM tok GROUP BY deprel")
query("stats_deprel_upos", lambda s, d: stats.by_field(views.orders(s, d), "deprel", "upos"), f"{TOK} SELECT deprel, upos, count(*) AS n FROM tok GROUP BY ALL")
FEATS = TOK + ", fe AS (SELECT sent, id, upos, 'Size' AS name, size AS value FROM tok UNION ALL SELECT sent, id, upos, 'Disc', disc FROM tok WHERE disc IS NOT NULL)"
query("stats_feat_upos", lambda s, d: stats.by_feature(views.orders(s, d)), f"{FEATS} SELECT upos, name, value, count(*) AS n FROM fe GROUP BY ALL")
query(
    "hist_sentlen",
    lambda s, d: stats.length_histogram(views.orders(s, d)).select(F.col("length").cast("long").alias("length"), "n"),
    f"""{TOK}, u AS (SELECT sent, count(*) + CASE WHEN sent % 5 = 0 THEN 1 ELSE 0 END AS length FROM tok GROUP BY sent) SELECT length, count(*) AS n FROM u
   GROUP BY length""",
)
query(
    "identical_groups",
    lambda s, d: stats.identical_groups(views.lines(s, d), "doc_id").select("text", "n", "first"),
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents) SELECT text, count(*) AS n, min(doc_id) AS first FROM l
   WHERE trim(text) <> '' GROUP BY text HAVING count(*) > 1""",
)
query(
    "feat_profile",
    lambda s, d: stats.feature_profile(views.orders(s, d), 30).select("upos", "name", "n", "tokens", F.round("rate", 4).alias("rate"), "place", "keep"),
    f"""{FEATS}, p AS (SELECT upos, name, count(*) AS n FROM fe GROUP BY ALL), a AS (SELECT upos, count(*) AS tokens FROM tok GROUP BY upos)
   SELECT upos, name, n, tokens, round(n * 100.0 / tokens, 4) AS rate, CAST(row_number() OVER (PARTITION BY upos ORDER BY n DESC, name) AS INTEGER) AS place, n * 100.0 / tokens >= 30 AS keep
   FROM p JOIN a USING (upos)""",
)
query(
    "topk_feats",
    lambda s, d: stats.feature_profile(views.orders(s, d)).where("place = 1").select("upos", "name", "n"),
    f"{FEATS} SELECT upos, name, count(*) AS n FROM fe WHERE name = 'Size' GROUP BY ALL",
)
query(
    "feat_values",
    lambda s, d: stats.feature_values(views.orders(s, d)),
    f"{FEATS} SELECT name, string_agg(DISTINCT value, '|' ORDER BY value) AS vals FROM fe GROUP BY name",
)
BOTH = SYS + ", b AS (SELECT g.sent, g.id, g.lemma = s.lemma AS lemma, g.upos = s.upos AS upos, g.head = s.head AS head, g.head = s.head AND g.deprel = s.deprel AS las, g.deprel = s.deprel AS deprel FROM tok g JOIN sys s USING (sent, id))"
query(
    "score_sentences",
    lambda s, d: (stats.scores(views.orders(s, d), views.orders(s, d, changed=True), "sent", ("lemma", "upos", "head", "las", "deprel"))
    .select("sent", *(F.round(x, 6).alias(x) for x in ("lemma", "upos", "head", "las", "deprel")))),
    f"{BOTH} SELECT sent, " + ", ".join(f"round(avg(CAST({x} AS INTEGER)), 6) AS {x}" for x in ("lemma", "upos", "head", "las", "deprel")) + " FROM b GROUP BY sent",
)
query(
    "score_corpus",
    lambda s, d: stats.corpus_scores(views.orders(s, d), views.orders(s, d, changed=True), "sent", ("lemma", "upos", "head", "las", "deprel")),
    f"{BOTH}, u AS (SELECT sent, " + ", ".join(f"avg(CAST({x} AS INTEGER)) AS {x}" for x in ("lemma", "upos", "head", "las", "deprel")) + " FROM b GROUP BY sent) SELECT " + ", ".join(f"round(avg({x}) * 100, 2) AS {x}" for x in ("lemma", "upos", "head", "las", "deprel")) + " FROM u",
)
query(
    "diff_tokens",
    lambda s, d: stats.different_words(views.orders(s, d), views.orders(s, d, changed=True), "sent"),
    f"""{SYS} SELECT g.sent AS sent, g.id AS id FROM tok g JOIN sys s USING (sent, id) WHERE g.upos <> s.upos OR g.head <> s.head OR g.deprel <> s.deprel""",
)
query(
    "annotation_errors",
    lambda s, d: stats.annotation_errors(views.orders(s, d, changed=True), ["A", "N", "R"], ["root", "dep0", "dep1", "dep2", "dep3", "dep4"]),
    f"""{SYS}
   SELECT CAST(sum(CASE WHEN upos = 'X' THEN 1 ELSE 0 END) AS BIGINT) AS upos, CAST(sum(CASE WHEN deprel = 'dep9' THEN 1 ELSE 0 END) AS BIGINT) AS deprels, CAST(0 AS BIGINT) AS extra_roots, CAST(sum(CASE WHEN (head = 0) <> (deprel = 'root') THEN 1 ELSE 0 END) AS BIGINT) AS root_labels
   FROM sys""",
)
query(
    "maxdist",
    lambda s, d: views.orders(s, d).select("sent", trees.longest_arc().cast("long").alias("longest")),
    f"{TOK} SELECT sent, max(CASE WHEN head > 0 THEN id - head ELSE 0 END) AS longest FROM tok GROUP BY sent",
)

# sequences
query(
    "seq_prec_next",
    lambda s, d: (views.orders(s, d)
    .select("sent", F.inline(F.transform("words", lambda w: F.struct(w["id"].alias("id"), F.get("words", w["id"] - 2)["form"].alias("before"), F.get("words", w["id"])["form"].alias("after")))))),
    f"""{TOK} SELECT sent, id, lag(form) OVER w AS before, lead(form) OVER w AS after FROM tok WINDOW w AS (PARTITION BY sent ORDER BY id)""",
)
query(
    "seq_offsets",
    lambda s, d: (_spaced(s, d)
    .select("sent", F.inline(tx.offsets()))
    .select("sent", "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))),
    f"{SPACED} SELECT sent, id, start, stop FROM off",
)
query(
    "seq_position",
    lambda s, d: (views.orders(s, d)
    .select("sent", F.explode(F.transform(F.array_sort(F.transform(F.concat("words", "empties"), lambda t: F.struct(t["id"], t["subid"], t["form"].alias("form")))), lambda t, i: F.struct((i + 1).alias("pos"), t["form"].alias("form")))).alias("x"))
    .select("sent", "x.pos", "x.form")),
    f"""{TOK}, e AS (SELECT sent, id, -1 AS sub, form FROM tok UNION ALL SELECT DISTINCT sent, 1, 1, 'gap' FROM tok WHERE sent % 5 = 0)
   SELECT sent, row_number() OVER (PARTITION BY sent ORDER BY id, sub) AS pos, form FROM e""",
)

# similarity
query(
    "sim_identical",
    lambda s, d: similar.copies(views.lines(s, d).select(F.concat_ws(":", "doc_id", "line_no").alias("id"), "text"), "id", "text"),
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
   FROM documents), k AS (SELECT doc_id || ':' || line_no AS id, text FROM l WHERE trim(text) <> '')
   SELECT id, min(id) OVER w AS first, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY text) QUALIFY n > 1""",
)
query(
    "sim_char",
    lambda s, d: similar.similar(views.read(s, d, "supplier"), None, "s_suppkey", "s_name", 1),
    """SELECT a.s_suppkey AS key1, b.s_suppkey AS key2, CAST(damerau_levenshtein(a.s_name, b.s_name) AS INTEGER) AS distance FROM supplier a
   JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE damerau_levenshtein(a.s_name, b.s_name) <= 1""",
)
query(
    "sim_two_groups",
    lambda s, d: similar.similar(views.read(s, d, "part").select("p_name").distinct(), views.read(s, d, "part").select("p_name").distinct(), "p_name", "p_name", 1),
    """WITH p AS (SELECT DISTINCT p_name FROM part)
   SELECT a.p_name AS key1, b.p_name AS key2, CAST(damerau_levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM p a, p b
   WHERE damerau_levenshtein(a.p_name, b.p_name) <= 1""",
)


# functions


def value(name: str, val: v.Value, sql: str) -> None:
    query(name, lambda s, d: views.orders(s, d).select("sent", F.explode(F.transform("words", lambda w: F.struct(w["id"].alias("id"), val(w).alias("val")))).alias("x")).select("sent", "x.id", "x.val"), f"{TOK} SELECT t.sent AS sent, t.id AS id, {sql} AS val FROM tok t LEFT JOIN tok h ON h.sent = t.sent AND h.id = t.head")


value("fn_concat", v.concat(v.this("Upos"), v.literal("_"), v.this("Deprel")), "t.upos || '_' || t.deprel")
value("fn_head", v.concat(v.head("Lemma"), v.literal("/"), v.this("Feat_Disc")), "coalesce(h.lemma, '') || '/' || coalesce(t.disc, '')")
value("fn_headhead", v.head("Form", 2), "coalesce((SELECT g.form FROM tok g WHERE g.sent = h.sent AND g.id = h.head), '')")
value("fn_this", v.concat(v.this("Misc_Line"), v.this("HeadId")), "CAST(t.line AS VARCHAR) || CAST(t.head AS VARCHAR)")
value("fn_literal", v.literal("x y"), "'x y'")
value("fn_substring", v.substring(v.this("Lemma"), 1, 6), "CASE WHEN length(t.lemma) >= 6 THEN substring(t.lemma, 2, 5) ELSE t.lemma END")
value("fn_replace", v.replace(v.this("Form"), "([aeiou])n", "$1N"), "regexp_replace(t.form, '([aeiou])n', '\\1N', 'g')")
value("fn_upper", v.upper(v.this("Form")), "upper(t.form)")
value("fn_lower", v.lower(v.this("Lemma")), "lower(t.lemma)")
value("fn_cap", v.capitalised(v.this("Lemma")), "upper(substring(t.lemma, 1, 1)) || lower(substring(t.lemma, 2))")
query(
    "fn_surface",
    lambda s, d: views.orders(s, d).select("sent", tx.surface().alias("text")),
    f"""{TOK}, p AS (SELECT sent, id, CASE WHEN sent % 3 = 0 AND n > 2 AND id = 1 THEN form || lead(form) OVER (PARTITION BY sent ORDER BY id) || ' ' WHEN sent % 3 = 0 AND n > 2 AND id = 2 THEN '' ELSE form || ' ' END AS piece
   FROM tok) SELECT sent, rtrim(string_agg(piece, '' ORDER BY id)) AS text FROM p GROUP BY sent""",
)
query(
    "fn_text_diff",
    lambda s, d: validate.text_mismatch(views.orders(s, d), "sent").select("sent", F.col("at").cast("long").alias("at")),
    f"{TOK} SELECT sent, CAST(length(form) AS BIGINT) AS at FROM tok WHERE id = 1 AND sent % 3 = 0 AND n > 2",
)
query(
    "fn_feats_parse",
    lambda s, d: (views.orders(s, d)
    .select("sent", F.inline("words"))
    .select("sent", "id", tx.feats_text(tx.feats_of(F.concat(F.lit("size=9|"), tx.feats_text(F.col("feats"))))).alias("feats"))),
    f"{TOK} SELECT sent, id, CASE WHEN disc IS NULL THEN '' ELSE 'Disc=Yes|' END || 'Size=' || size AS feats FROM tok",
)
query(
    "fn_misc_parse",
    lambda s, d: (views.orders(s, d)
    .select("sent", F.inline("words"))
    .select("sent", "id", tx.misc_text(tx.misc_of(F.concat(tx.misc_text(F.col("misc")), F.lit("|Flag")))).alias("misc"))),
    f"""{TOK} SELECT sent, id, 'Line=' || line || CASE WHEN psize % 2 = 0 THEN '|Gloss=' || brand ELSE '' END || '|Flag' AS misc FROM tok""",
)
query(
    "fn_deps_parse",
    lambda s, d: views.orders(s, d).select("sent", F.inline("words")).select("sent", "id", tx.deps_text(tx.deps_of(tx.deps_text(F.col("deps")))).alias("deps")),
    f"""{TOK} SELECT sent, id, head || ':' || deprel || CASE WHEN id > 2 THEN '|' || (id - 2) || ':ext' ELSE '' END AS deps FROM tok""",
)
query(
    "fn_subphrase",
    lambda s, d: views.orders(s, d).select("sent", tx.subphrase(["dep1", "dep2"]).alias("phrase")),
    f"""{TOK}, b AS (SELECT sent, min(id) AS a, max(id) AS z FROM tok WHERE deprel IN ('dep1', 'dep2') GROUP BY sent), u AS (SELECT DISTINCT sent FROM tok)
   SELECT u.sent AS sent, coalesce((SELECT string_agg(t.form, ' ' ORDER BY t.id) FROM tok t JOIN b ON b.sent = t.sent
   WHERE t.sent = u.sent AND t.id BETWEEN b.a AND b.z), '') AS phrase FROM u""",
)

# trees
UP = TOK.replace("WITH raw", "WITH RECURSIVE raw") + ", up AS (SELECT sent, id, head AS anc, 1 AS dist FROM tok WHERE head > 0 UNION ALL SELECT u.sent, u.id, t.head, u.dist + 1 FROM up u JOIN tok t ON t.sent = u.sent AND t.id = u.anc WHERE t.head > 0)"
query(
    "tree_ancestors",
    lambda s, d: (trees.with_ancestors(views.orders(s, d))
    .select("sent", F.posexplode("up").alias("i", "up"))
    .select("sent", (F.col("i") + 1).cast("long").alias("id"), F.size("up").cast("long").alias("depth"), F.aggregate("up", F.lit(0), lambda a, x: a + x).cast("long").alias("sum_up"))),
    f"""{UP} SELECT t.sent AS sent, t.id AS id, count(u.anc) AS depth, CAST(coalesce(sum(u.anc), 0) AS BIGINT) AS sum_up FROM tok t LEFT
   JOIN up u ON u.sent = t.sent AND u.id = t.id GROUP BY ALL""",
)
query(
    "tree_dominates",
    lambda s, d: views.orders(s, d).select("sent", F.size(trees.dominated(2)).cast("long").alias("n")).where("n > 0"),
    f"{UP} SELECT sent, count(*) AS n FROM up WHERE anc = 2 GROUP BY sent",
)
query(
    "tree_subtree",
    lambda s, d: views.orders(s, d).select("sent", F.inline(trees.subtree(2))).select("sent", "id", "form", "head"),
    f"""{UP}, k AS (SELECT t.sent, t.id, t.form, t.head, row_number() OVER (PARTITION BY t.sent ORDER BY t.id) AS nid FROM tok t
   WHERE t.id = 2 OR EXISTS (SELECT 1 FROM up u WHERE u.sent = t.sent AND u.id = t.id AND u.anc = 2))
SELECT k.sent AS sent, k.nid AS id, k.form AS form, CASE WHEN k.id = 2 THEN 0 ELSE h.nid END AS head FROM k LEFT
   JOIN k h ON h.sent = k.sent AND h.id = k.head""",
)
query(
    "tree_is_span",
    lambda s, d: views.orders(s, d).where(trees.is_span(2, 4)).select("sent"),
    f"{TOK} SELECT sent FROM tok WHERE id BETWEEN 2 AND 4 AND head NOT BETWEEN 2 AND 4 GROUP BY sent HAVING count(*) = 1",
)
query(
    "tree_projective",
    lambda s, d: views.orders(s, d).where(~trees.is_projective()).select("sent"),
    f"""{UP} SELECT DISTINCT t.sent AS sent FROM tok t JOIN tok x ON x.sent = t.sent AND x.id > least(t.id, t.head) AND x.id < greatest(t.id, t.head)
   WHERE t.head > 0 AND abs(t.id - t.head) > 2 AND NOT EXISTS (SELECT 1 FROM up u WHERE u.sent = x.sent AND u.id = x.id AND u.anc = t.head)""",
)
pattern("grew_global_projective", grew.Pattern({"N": c.upos("N") & c.feat("Size", "0")}, tests=[grew.projective()]), "")
ORACLES["grew_global_projective"] = f"{UP}, bad AS (SELECT DISTINCT t.sent AS sent FROM tok t JOIN tok x ON x.sent = t.sent AND x.id > least(t.id, t.head) AND x.id < greatest(t.id, t.head) WHERE t.head > 0 AND abs(t.id - t.head) > 2 AND NOT EXISTS (SELECT 1 FROM up u WHERE u.sent = x.sent AND u.id = x.id AND u.anc = t.head)) SELECT sent, id AS n FROM tok t WHERE upos = 'N' AND size = '0' AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.sent = t.sent)"
query("tree_is_tree", lambda s, d: views.orders(s, d).where(grew.tree()()).select("sent"), f"{TOK} SELECT sent FROM tok WHERE head = 0 GROUP BY sent HAVING count(*) = 1")
query(
    "tree_build_check",
    lambda s, d: (views.orders(s, d).withColumn("words", F.transform("words", lambda w: F.when((w["id"] == 1) & (F.col("sent") % 4 == 1), w.withField("head", F.lit(2))).when((w["id"] == 2) & (F.col("sent") % 4 == 3), w.withField("head", F.lit(99))).otherwise(w)))
    .select("sent", F.array_join(trees.problems(), "+").alias("problems"))
    .where("problems <> ''")),
    f"""{TOK}, u AS (SELECT sent, count(*) AS n FROM tok GROUP BY sent)
SELECT sent, CASE WHEN sent % 4 = 1 AND n = 1 THEN 'head beyond the sentence+no root' WHEN sent % 4 = 1 THEN 'no root+cycle' ELSE 'head beyond the sentence' END AS problems
   FROM u WHERE sent % 4 = 1 OR (sent % 4 = 3 AND n > 1)""",
)
query(
    "tree_children_label",
    lambda s, d: (views.orders(s, d)
    .select("sent", F.explode(F.transform("words", lambda w: F.struct(w["id"].alias("id"), F.size(trees.children_with(w, "dep[12]")).cast("long").alias("n")))).alias("x"))
    .select("sent", "x.id", "x.n")
    .where("n > 0")),
    f"{TOK} SELECT sent, head AS id, count(*) AS n FROM tok WHERE head > 0 AND deprel IN ('dep1', 'dep2') GROUP BY ALL",
)

# updates
RULES = [edit.Rule(c.upos("R") & c.head(c.upos("N")), {"Xpos": v.concat(v.this("Xpos"), v.literal("+"), v.head("Lemma")), "Feat_Disc": ""}), edit.Rule(c.feat("Size", "2"), {"Deprel": "big", "Misc_Note": v.lower(v.this("Lemma"))})]


def _edit_rules(s: SparkSession, d: str) -> DataFrame:
    out = edit.apply_rules(views.orders(s, d), RULES)
    return out.select("sent", F.inline("words")).select("sent", "id", "xpos", "deprel", tx.feats_text(F.col("feats")).alias("feats"), tx.misc_text(F.col("misc")).alias("misc"))


query(
    "edit_rules",
    _edit_rules,
    f"""{TOK}, q AS (SELECT t.*, t.upos = 'R' AND coalesce(h.upos = 'N', false) AS r1, h.lemma AS hl FROM tok t LEFT
   JOIN tok h ON h.sent = t.sent AND h.id = t.head)
SELECT sent, id, CASE WHEN r1 THEN xpos || '+' || hl ELSE xpos END AS xpos, CASE WHEN size = '2' THEN 'big' ELSE deprel END AS deprel, CASE WHEN disc IS NOT NULL AND NOT r1 THEN 'Disc=Yes|' ELSE '' END || 'Size=' || size AS feats,
 'Line=' || line || CASE WHEN psize % 2 = 0 THEN '|Gloss=' || brand ELSE '' END || CASE WHEN size = '2' THEN '|Note=' || lower(lemma) ELSE '' END AS misc
   FROM q""",
)


def _edit_in_sequence(s: SparkSession, d: str) -> DataFrame:
    rules = [edit.Rule(c.prec(c.xpos("F")), {"Xpos": "F", "Misc_Was": v.this("Xpos")}), edit.Rule(c.prec(c.deprel("dep[34]")) & c.upos("A"), {"Deprel": "dep4"})]
    out = edit.apply_rules(views.orders(s, d), rules, sequential=True)
    words = out.select("sent", F.col("changes")[0].alias("n"), F.inline("words"))
    return words.select("sent", "id", "xpos", "deprel", F.col("n").cast("long").alias("n"))


query(
    "edit_rules_sequential",
    _edit_in_sequence,
    f"""{TOK.replace("WITH raw", "WITH RECURSIVE raw")}, r AS (SELECT sent, id, deprel FROM tok WHERE id = 1 UNION ALL SELECT t.sent, t.id, CASE WHEN t.upos = 'A' AND r.deprel IN ('dep3', 'dep4') THEN 'dep4' ELSE t.deprel END
   FROM r JOIN tok t ON t.sent = r.sent AND t.id = r.id + 1),
 f AS (SELECT sent, id, coalesce(max(CASE WHEN xpos = 'F' THEN 1 END) OVER (PARTITION BY sent ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hit, xpos FROM tok)
 SELECT f.sent AS sent, f.id AS id, CASE WHEN hit = 1 THEN 'F' ELSE xpos END AS xpos, r.deprel AS deprel, CAST(sum(hit) OVER (PARTITION BY f.sent) AS BIGINT) AS n FROM f JOIN r USING (sent, id)""",
)


def _changes(s: SparkSession, d: str) -> DataFrame:
    from .plans.rules import mass_edit

    return mass_edit(views.orders(s, d), RULES)[1].withColumn("rule", F.col("rule").cast("long"))


query(
    "edit_changes",
    _changes,
    f"""{TOK}, q AS (SELECT t.upos = 'R' AND coalesce(h.upos = 'N', false) AS r1, t.size = '2' AS r2 FROM tok t LEFT
   JOIN tok h ON h.sent = t.sent AND h.id = t.head) SELECT CAST(1 AS BIGINT) AS rule, count(*) AS changes FROM q WHERE r1 UNION ALL SELECT 2, count(*)
   FROM q WHERE r2""",
)
query(
    "edit_head",
    lambda s, d: edit.apply_rules(views.orders(s, d), [edit.Rule(c.upos("A"), {"HeadId": "+1"})]).select("sent", F.inline("words")).select("sent", "id", "head"),
    f"""{UP} SELECT t.sent AS sent, t.id AS id, CASE WHEN t.upos = 'A' AND t.id < t.n AND NOT EXISTS (SELECT 1 FROM up u
   WHERE u.sent = t.sent AND u.id = t.id + 1 AND u.anc = t.id) THEN t.id + 1 ELSE t.head END AS head FROM tok t""",
)
query(
    "edit_eud",
    lambda s, d: (edit.apply_rules(views.orders(s, d), [edit.Rule(c.upos("A"), {"eud": "-1:conj"}), edit.Rule(c.upos("N"), {"eud": "_"})])
    .select("sent", F.inline("words"))
    .select("sent", "id", tx.deps_text(F.col("deps")).alias("deps"))),
    f"""{TOK}
   SELECT sent, id, CASE WHEN upos = 'N' THEN '_' ELSE head || ':' || deprel || CASE WHEN id > 2 THEN '|' || (id - 2) || ':ext' ELSE '' END || CASE WHEN upos = 'A' THEN '|' || (id - 1) || ':conj' ELSE '' END END AS deps
   FROM tok""",
)


query(
    "edit_reattach",
    lambda s, d: (edit.reattach(views.orders(s, d), 2, 4, "moved")
    .select("sent", F.explode("words").alias("w"), "warning")
    .select("sent", "w.id", "w.head", "w.deprel", "warning")),
    f"""{UP}, why AS (SELECT t.sent, CASE WHEN t.n < 4 THEN 'head is outside the sentence' WHEN EXISTS (SELECT 1 FROM up u
   WHERE u.sent = t.sent AND u.id = 4 AND u.anc = 2) THEN 'head is below the word' END AS warning FROM tok t WHERE t.id = 2)
   SELECT t.sent AS sent, t.id AS id, CASE WHEN t.id = 2 AND w.warning IS NULL THEN 4 ELSE t.head END AS head, CASE WHEN t.id = 2 AND w.warning IS NULL THEN 'moved' ELSE t.deprel END AS deprel, w.warning AS warning
   FROM tok t LEFT JOIN why w ON w.sent = t.sent""",
)
query(
    "edit_ed",
    lambda s, d: (edit.drop_enhanced(edit.add_enhanced(views.orders(s, d), 3, 2, "new"), 3, 1, "ext")
    .select("sent", F.explode("words").alias("w"))
    .select("sent", F.col("w.id").alias("id"), tx.deps_text(F.col("w.deps")).alias("deps"))),
    f"""{TOK}
   SELECT sent, id, head || ':' || deprel || CASE WHEN id > 2 AND id <> 3 THEN '|' || (id - 2) || ':ext' WHEN id = 3 THEN '|2:new' ELSE '' END AS deps
   FROM tok""",
)
query(
    "mwt_compose",
    lambda s, d: edit.compose_mwt(views.orders(s, d), 2, 3).select("sent", F.inline("mwts")).select("sent", "id", "subid", "form"),
    f"""{TOK}, f AS (SELECT sent, n, max(CASE WHEN id = 1 THEN form END) AS a, max(CASE WHEN id = 2 THEN form END) AS b, max(CASE WHEN id = 3 THEN form END) AS c
   FROM tok GROUP BY ALL) SELECT sent, CAST(1 AS BIGINT) AS id, 2 AS subid, a || b AS form FROM f WHERE sent % 3 = 0 AND n > 2 UNION ALL
   SELECT sent, 2, 3, b || c FROM f WHERE sent % 3 <> 0 AND n > 2""",
)
query(
    "mwt_edit",
    lambda s, d: edit.drop_mwt(views.orders(s, d), 1).select("sent", F.size("mwts").cast("long").alias("n")),
    f"{TOK} SELECT DISTINCT sent, CAST(0 AS BIGINT) AS n FROM tok",
)
query(
    "tok_empty_insert",
    lambda s, d: edit.insert_empty(views.orders(s, d), 1, "e").select("sent", F.inline("empties")).select("sent", "id", "subid", "form"),
    f"""{TOK}, u AS (SELECT DISTINCT sent FROM tok) SELECT sent, 1 AS id, 1 AS subid, 'gap' AS form FROM u WHERE sent % 5 = 0 UNION ALL
   SELECT sent, 1, CASE WHEN sent % 5 = 0 THEN 2 ELSE 1 END, 'e' FROM u""",
)
query(
    "tok_empty_delete",
    lambda s, d: edit.drop_empty(views.orders(s, d), 1, 1).select("sent", F.size("empties").cast("long").alias("n")),
    f"{TOK} SELECT DISTINCT sent, CAST(0 AS BIGINT) AS n FROM tok",
)
query(
    "highlight_from_validator",
    lambda s, d: (edit.highlights_from_messages(views.read(s, d, "lineitem")
    .where("l_quantity > 45")
    .select(F.concat(F.lit("Sent "), "l_orderkey", F.lit(" Node "), "l_linenumber", F.lit(" bad")).alias("message")))),
    """WITH m AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45)
   SELECT CAST(l_orderkey AS VARCHAR) AS sent_id, 'highlight tokens = ' || string_agg(CAST(l_linenumber AS VARCHAR), ' ' ORDER BY l_linenumber) AS comment
   FROM m GROUP BY 1""",
)
query(
    "version_before",
    lambda s, d: edit.latest(views.read(s, d, "events"), "user_id", "event_id", "event_type", undo=1).select("user_id", "event_id", "event_type"),
    """SELECT user_id, event_id, event_type
   FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
   WHERE k = least(2, n)""",
)



#: Of the events of a user, errors and purchases undo, signups redo, others are edits.
def _log(s: SparkSession, d: str) -> DataFrame:
    command = F.when(F.col("event_type").isin("error", "purchase"), "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit")
    return views.read(s, d, "events").select("user_id", "event_id", command.alias("command"), F.col("event_id").alias("value"))


query(
    "undo_redo",
    lambda s, d: history.replay(_log(s, d), "user_id", "event_id", depth=4, each=True),
    """WITH RECURSIVE c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
   CASE WHEN event_type IN ('error', 'purchase') THEN 'undo' WHEN event_type = 'signup' THEN 'redo' ELSE 'edit' END AS what FROM events),
 r AS (SELECT DISTINCT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS now, CAST([] AS BIGINT[]) AS past, CAST([] AS BIGINT[]) AS future FROM events
   UNION ALL SELECT r.user_id, c.event_id, c.k,
     CASE WHEN what = 'edit' THEN c.event_id WHEN what = 'undo' AND len(past) > 0 THEN past[-1] WHEN what = 'redo' AND len(future) > 0 THEN future[-1] ELSE now END,
     CASE WHEN what = 'undo' THEN past[:len(past) - 1] WHEN what = 'edit' OR len(future) > 0 THEN list_append(past, now)[greatest(1, len(past) - 2):] ELSE past END,
     CASE WHEN what = 'edit' THEN [] WHEN what = 'redo' THEN future[:len(future) - 1] WHEN len(past) > 0 THEN list_append(future, now)[greatest(1, len(future) - 2):] ELSE future END
   FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1)
 SELECT user_id, event_id, now AS value, len(past) AS undo, len(future) AS redo FROM r WHERE k > 0""",
)


# validation
IMPLIES = [(c.upos("R"), c.head(c.upos("N")) | c.token_id(1)), (c.feat("Disc"), c.xpos("O"))]
query(
    "valid_rules",
    lambda s, d: validate.implications(views.orders(s, d), IMPLIES, "sent"),
    f"""{TOK} SELECT sent, 1 AS rule, id FROM tok t WHERE upos = 'R' AND id <> 1 AND NOT {HEAD.format(chr(104) + '.upos = ' + chr(39) + 'N' + chr(39))}
   UNION ALL SELECT sent, 2, id FROM tok WHERE disc IS NOT NULL AND xpos <> 'O'""",
)


def _check(s: SparkSession, d: str) -> DataFrame:
    from .plans.rules import check

    return check(views.orders(s, d), IMPLIES, "sent")


query(
    "valid_summary",
    _check,
    f"""{TOK}, b AS (SELECT sent, 1 AS rule, id FROM tok t WHERE upos = 'R' AND id <> 1 AND NOT {HEAD.format(chr(104) + '.upos = ' + chr(39) + 'N' + chr(39))}
   UNION ALL SELECT sent, 2, id FROM tok WHERE disc IS NOT NULL AND xpos <> 'O')
   SELECT rule, count(*) AS violations, count(DISTINCT sent) AS sentences FROM b GROUP BY rule""",
)
query(
    "valid_lists",
    lambda s, d: validate.permitted(views.orders(s, d, changed=True), ["A", "N", "R"], ["F", "O"], ["root", "dep0", "dep1", "dep2", "dep3", "dep4"], "sent"),
    f"""{SYS} SELECT sent, id, CASE WHEN upos = 'X' AND deprel = 'dep9' THEN 'upos+deprel' WHEN upos = 'X' THEN 'upos' ELSE 'deprel' END AS wrong FROM sys
   WHERE upos = 'X' OR deprel = 'dep9'""",
)


def _valid_feats(s: SparkSession, d: str) -> DataFrame:
    allowed = s.createDataFrame([(u, "Size", x) for u in "AN" for x in "0123"] + [("A", "Disc", "Yes")], "upos string, name string, value string")
    return validate.feature_codes(views.orders(s, d), allowed, "sent")


query(
    "valid_feats",
    _valid_feats,
    f"""{FEATS} SELECT sent, id, name, CASE WHEN upos = 'R' OR (name = 'Disc' AND upos <> 'A') THEN 1 ELSE 2 END AS code FROM fe
   WHERE upos = 'R' OR (name = 'Disc' AND upos <> 'A') OR (name = 'Size' AND value NOT IN ('0', '1', '2', '3'))""",
)

# sinks and sources as columns


def blocks(s: SparkSession, d: str, sentences: bool = False) -> DataFrame:
    """The orders view written as CoNLL-U text, one block per sentence; or the sentences that are written."""
    none = F.lit(None).cast("string")
    sents = views.orders(s, d).withColumns({
        "sent_id": F.col("sent").cast("string"), "newdoc": none, "newpar": none, "translit": none,
        "translations": F.create_map().cast("map<string,string>"), "comments": F.array().cast("array<string>"),
    })
    return sents if sentences else sents.select("sent", conllu.block().alias("value"))


query(
    "sink_conllu",
    lambda s, d: blocks(s, d).select("sent", F.sha2("value", 256).alias("sha")),
    f"""{TOK}, l AS (SELECT sent, id, 1 AS k, concat_ws(chr(9), id, form, lemma, upos, xpos, CASE WHEN disc IS NULL THEN '' ELSE 'Disc=Yes|' END || 'Size=' || size, head, deprel, head || ':' || deprel || CASE WHEN id > 2 THEN '|' || (id - 2) || ':ext' ELSE '' END, 'Line=' || line || CASE WHEN psize % 2 = 0 THEN '|Gloss=' || brand ELSE '' END) AS line
   FROM tok
UNION ALL SELECT sent, 1, 0, concat_ws(chr(9), '1-2', string_agg(form, '' ORDER BY id), '_', '_', '_', '_', '_', '_', '_', '_') FROM tok
   WHERE sent % 3 = 0 AND n > 2 AND id <= 2 GROUP BY sent
UNION ALL SELECT DISTINCT sent, 1, 2, concat_ws(chr(9), '1.1', 'gap', '_', 'E', '_', '_', '_', '_', '_', '_') FROM tok WHERE sent % 5 = 0),
 x AS (SELECT sent, string_agg(form, ' ' ORDER BY id) AS txt FROM tok GROUP BY sent)
SELECT x.sent AS sent, sha256('# sent_id = ' || x.sent || chr(10) || '# text = ' || any_value(x.txt) || chr(10) || string_agg(l.line, chr(10) ORDER BY l.id, l.k)) AS sha
   FROM x JOIN l ON l.sent = x.sent GROUP BY x.sent""",
)
query(
    "scan_sentence_block",
    lambda s, d: conllu.parse(blocks(s, d)).select("sent", F.inline("words")).select("sent", "id", "form", "upos", "head", "deprel"),
    f"{TOK} SELECT sent, id, form, upos, head, deprel FROM tok",
)
query(
    "scan_token_line",
    lambda s, d: (conllu.parse(blocks(s, d).withColumn("value", F.when(F.col("sent") % 7 == 0, F.regexp_replace("value", "\tA\t", "\t")).otherwise(F.col("value"))))
    .select("sent", F.size("errors").cast("long").alias("n"))
    .where("n > 0")),
    f"{TOK} SELECT sent, count(*) AS n FROM tok WHERE sent % 7 = 0 AND upos = 'A' GROUP BY sent",
)
query(
    "sink_conllu_plus",
    lambda s, d: (conllu.convert_columns(blocks(s, d), conllu.COLUMNS, ("ID", "FORM", "SEM:NE", "UPOS"))
    .select("sent", F.explode(F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#") & ~F.split(x, "\t")[0].rlike("[-.]"))).alias("line"))),
    f"{TOK} SELECT sent, concat_ws(chr(9), id, form, '_', upos) AS line FROM tok",
)
query("sink_text", lambda s, d: views.orders(s, d).select("sent", tx.surface().alias("line")), ORACLES["fn_surface"].replace("AS text FROM p", "AS line FROM p"))
query(
    "sink_sdparse",
    lambda s, d: views.orders(s, d).select("sent", export.sd_parse().alias("sd")),
    f"""{TOK}, a AS (SELECT t.sent, string_agg(t.deprel || '(' || h.form || '-' || h.id || ', ' || t.form || '-' || t.id || ')', chr(10) ORDER BY t.id) AS arcs
   FROM tok t JOIN tok h ON h.sent = t.sent AND h.id = t.head GROUP BY t.sent), x AS (SELECT sent, string_agg(form, ' ' ORDER BY id) AS txt FROM tok
   GROUP BY sent)
SELECT x.sent AS sent, txt || chr(10) || coalesce(arcs, '') AS sd FROM x LEFT JOIN a ON a.sent = x.sent""",
)
query(
    "lines_length",
    lambda s, d: views.lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.size("words").cast("long").alias("n")),
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
   FROM documents) SELECT doc_id, line_no, CAST(len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS BIGINT) AS n FROM l
   WHERE trim(text) <> ''""",
)
query(
    "scan_string",
    lambda s, d: (conllu.parse(blocks(s, d)
    .groupBy(F.floor(F.col("sent") / 50).alias("file"))
    .agg(F.array_join(F.array_sort(F.collect_list("value")), "\n\n").alias("text"))
    .select("file", F.explode(F.split("text", "\n\n")).alias("value")))
    .select(F.col("sent_id").cast("long").alias("sent"), F.size("words").cast("long").alias("n"))),
    f"{TOK} SELECT sent, count(*) AS n FROM tok GROUP BY sent",
)
query(
    "scan_sdparse",
    lambda s, d: (sdparse.parse(views.orders(s, d).withColumn("words", F.transform("words", lambda w: w.withField("form", F.replace(w["form"], F.lit(" "), F.lit("_")))))
    .select("sent", export.sd_parse().alias("value")))
    .select("sent", F.inline("words"))
    .select("sent", "id", "form", "head", "deprel")),
    f"{TOK} SELECT sent, id, replace(form, ' ', '_') AS form, head, deprel FROM tok",
)
query(
    "find_grew",
    lambda s, d: (search.after(grew.match(views.orders(s, d), grew.Pattern({"H": c.upos("N"), "D": c.upos("R")}, [("H", "D", ["dep1"])]), "sent")
    .select("sent").distinct(), "sent", 200, backwards=True)),
    f"""{TOK} SELECT max(h.sent) AS sent FROM tok h JOIN tok d ON d.sent = h.sent AND d.head = h.id
   WHERE h.sent < 200 AND h.upos = 'N' AND d.upos = 'R' AND d.deprel = 'dep1'""",
)
query(
    "fn_surface_list",
    lambda s, d: views.orders(s, d).select("sent", F.explode(tx.surface_pieces()).alias("id", "piece")),
    f"{TOK} SELECT sent, id, form || ' ' AS piece FROM tok",
)
query(
    "fn_spaces",
    lambda s, d: (views.read(s, d, "nation")
    .select("n_nationkey", tx.spaces(F.array(F.struct(F.when(F.col("n_nationkey") % 2 == 0, "SpaceAfter").otherwise("SpacesAfter").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "No").otherwise(r"\s\t").alias("val")))).alias("after"))),
    "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ' ' || chr(9) END AS after FROM nation",
)
query(
    "edit_feat",
    lambda s, d: (edit.apply_rules(views.orders(s, d), [edit.Rule(c.upos("A"), {"Feat_Case": "Nom", "Feat_disc": ""}), edit.Rule(c.upos("N"), {"feats": "_"})])
    .select("sent", F.inline("words"))
    .select("sent", "id", tx.feats_text(F.col("feats")).alias("feats"))),
    f"""{TOK}
   SELECT sent, id, CASE WHEN upos = 'N' THEN '_' ELSE CASE WHEN upos = 'A' THEN 'Case=Nom|' WHEN disc IS NOT NULL THEN 'Disc=Yes|' ELSE '' END || 'Size=' || size END AS feats
   FROM tok""",
)
query(
    "edit_misc",
    lambda s, d: (edit.apply_rules(views.orders(s, d), [edit.Rule(c.upos("A"), {"Misc_Line": v.this("Xpos"), "Misc_Gloss": ""}), edit.Rule(c.upos("N"), {"misc": "_"})])
    .select("sent", F.inline("words"))
    .select("sent", "id", tx.misc_text(F.col("misc")).alias("misc"))),
    f"""{TOK}
   SELECT sent, id, CASE WHEN upos = 'N' THEN '_' WHEN upos = 'A' THEN 'Line=' || xpos ELSE 'Line=' || line || CASE WHEN psize % 2 = 0 THEN '|Gloss=' || brand ELSE '' END END AS misc
   FROM tok""",
)
query(
    "edit_replace_next",
    lambda s, d: (edit.replace_next(views.orders(s, d), edit.Rule(c.upos("R") & c.xpos("O"), {"Lemma": v.upper(v.this("Form"))}), "sent", 300)
    .select("sent", F.inline("words"))
    .select("sent", "id", "lemma")),
    f"""{TOK}, x AS (SELECT min(sent) AS sent FROM tok WHERE sent > 300 AND upos = 'R' AND xpos = 'O')
   SELECT t.sent AS sent, id, CASE WHEN upos = 'R' AND xpos = 'O' THEN upper(form) ELSE lemma END AS lemma FROM tok t JOIN x ON x.sent = t.sent""",
)
query(
    "comment_edit",
    lambda s, d: (edit.set_comments(views.orders(s, d)
    .select("sent", F.array(F.lit("old")).alias("comments")), views.read(s, d, "orders")
    .where("o_orderstatus = 'F'")
    .select(F.col("o_orderkey").alias("sent"), F.concat(F.lit("a\n"), "o_orderpriority").alias("comment")), "sent")
    .select("sent", F.array_join("comments", "+").alias("comments"))),
    f"""{TOK}, u AS (SELECT DISTINCT sent FROM tok) SELECT sent, CASE WHEN o_orderkey IS NULL THEN 'old' ELSE 'a+' || o_orderpriority END AS comments FROM u
   LEFT JOIN orders ON o_orderkey = sent AND o_orderstatus = 'F'""",
)

from . import queries_files, queries_structure  # noqa: E402, F401 - they register more
