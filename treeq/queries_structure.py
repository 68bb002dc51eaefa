"""Queries of structural edits: all tokens of a sentence (words, multiword and empty tokens, with enhanced edges) after the edit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import conditions as c
from .functions import text as tx
from .operators import corpus, edit, grew
from .registry import PATTERNS, TOK, query
from .sources import views


def every_token(sents: DataFrame, *keys: str) -> DataFrame:
    """A row per token of any kind: keys, kind, id, subid, form, head, deps (as text)."""
    token = lambda t: F.struct(*(t[f].alias(f) for f in ("kind", "id", "subid", "form", "head")), tx.deps_text(t["deps"]).alias("deps"))
    return sents.select(*keys, F.inline(F.transform(F.concat("words", "mwts", "empties"), token)))


#: Enhanced edges of the words of tok, in order; multiword tokens and the form they have; sentences with an empty word.
PARTS = """
 e AS (SELECT sent, id, 1 AS o, head AS h, deprel AS rel FROM tok UNION ALL SELECT sent, id, 2, id - 2, 'ext' FROM tok WHERE id > 2),
 mform AS (SELECT sent, string_agg(form, '' ORDER BY id) AS form FROM tok WHERE sent % 3 = 0 AND n > 2 AND id <= 2 GROUP BY sent)"""


def tokens_sql(k: str, edge: str = "e.h", more_mwts: str = "") -> str:
    """Tokens after an edit, from k (sent, nid, old, cover, form, head): words in new order with their old ids (null for new ones), the old id by which a
    multiword token covers them, and heads by old id. `edge` is an edge's head by old id."""
    return f"""{TOK}, {k},{PARTS},
 x AS (SELECT e.sent, e.id, e.o, e.rel, {edge} AS h FROM e LEFT JOIN (SELECT DISTINCT sent, n FROM tok) s ON s.sent = e.sent),
 d AS (SELECT k.sent, k.nid, string_agg((CASE WHEN x.h <= 0 THEN x.h ELSE m.nid END) || ':' || x.rel, '|' ORDER BY x.o) AS deps
   FROM k JOIN x ON x.sent = k.sent AND x.id = k.old LEFT JOIN k m ON m.sent = k.sent AND m.old = x.h
   WHERE (x.h <= 0 OR m.nid IS NOT NULL) AND x.h <> x.id GROUP BY ALL),
 cov AS (SELECT sent, 1 AS a, 2 AS z, form FROM mform {more_mwts})
 SELECT k.sent AS sent, 'WORD' AS kind, k.nid AS id, -1 AS subid, k.form AS form, CASE WHEN k.head <= 0 THEN k.head ELSE coalesce(h.nid, 0) END AS head,
   coalesce(d.deps, '_') AS deps
 FROM k LEFT JOIN k h ON h.sent = k.sent AND h.old = k.head LEFT JOIN d ON d.sent = k.sent AND d.nid = k.nid
 UNION ALL SELECT cov.sent, 'MWT', min(k.nid), max(k.nid), cov.form, -1, '_' FROM cov JOIN k ON k.sent = cov.sent AND k.cover BETWEEN cov.a AND cov.z
   GROUP BY cov.sent, cov.a, cov.form HAVING max(k.nid) > min(k.nid)
 UNION ALL SELECT u.sent, 'EMPTY', coalesce(max(CASE WHEN k.cover <= 1 THEN k.nid END), 0), 1, 'gap', -1, '_'
   FROM (SELECT DISTINCT sent FROM tok WHERE sent % 5 = 0) u LEFT JOIN k ON k.sent = u.sent GROUP BY u.sent"""


def structure(name: str, run: Callable[[DataFrame], DataFrame], k: str, **more: str) -> None:
    query(name, lambda s, d: every_token(run(views.orders(s, d)), "sent"), tokens_sql(k, **more))


structure(
    "tok_delete", lambda v: edit.delete_word(v, 2),
    """k AS (SELECT t.sent, row_number() OVER (PARTITION BY t.sent ORDER BY t.id) AS nid, t.id AS old, t.id AS cover, t.form,
   CASE WHEN t.head = 2 THEN g.head ELSE t.head END AS head FROM tok t LEFT JOIN tok g ON g.sent = t.sent AND g.id = 2 WHERE t.id <> 2)""",
)
structure(
    "tok_insert", lambda v: edit.insert_word(v, 1, "new"),
    """k AS (SELECT sent, CASE WHEN id > 1 THEN id + 1 ELSE id END AS nid, id AS old, id AS cover, form, head FROM tok
   UNION ALL SELECT DISTINCT sent, 2, NULL, NULL, 'new', 1 FROM tok)""",
)
structure(
    "tok_insert_front", lambda v: edit.insert_word(v, 0, "new"),
    """k AS (SELECT sent, id + 1 AS nid, id AS old, id AS cover, form, head FROM tok UNION ALL SELECT DISTINCT sent, 1, NULL, NULL, 'new', 1 FROM tok)""",
)
structure(
    "tok_join", lambda v: edit.join_words(v, 1),
    """k AS (SELECT t.sent, CASE WHEN t.id > 1 THEN t.id - 1 ELSE 1 END AS nid, t.id AS old, t.id AS cover, CASE WHEN t.id = 1 THEN t.form || coalesce(b.form, '') ELSE t.form END AS form,
   CASE WHEN t.head = 2 THEN 1 ELSE t.head END AS head FROM tok t LEFT JOIN tok b ON b.sent = t.sent AND b.id = 2 WHERE t.id <> 2)""",
    edge="CASE WHEN e.h = 2 THEN 1 ELSE e.h END",
)
structure(
    "tok_split", lambda v: edit.split_word(v, 1, 3),
    """k AS (SELECT sent, CASE WHEN id > 1 THEN id + 1 ELSE id END AS nid, id AS old, id AS cover, CASE WHEN id = 1 THEN substring(form, 1, 3) ELSE form END AS form, head FROM tok
   UNION ALL SELECT sent, 2, NULL, 1, substring(form, 4), 1 FROM tok WHERE id = 1)""",
)
structure(
    "mwt_tomwt", lambda v: edit.split_to_mwt(v, 3, ["one", "two"]),
    """k AS (SELECT sent, CASE WHEN id > 3 THEN id + 1 ELSE id END AS nid, id AS old, id AS cover, CASE WHEN id = 3 THEN 'one' ELSE form END AS form, head FROM tok
   UNION ALL SELECT sent, 4, NULL, 3, 'two', 3 FROM tok WHERE id = 3)""",
    more_mwts="UNION ALL SELECT sent, 3, 3, form FROM tok WHERE id = 3",
)
structure(
    "tok_compact", lambda v: edit.compact(v, ["red widget", "red widget"]),
    """run AS (SELECT a.sent, min(a.id) AS a FROM tok a JOIN tok b ON b.sent = a.sent AND b.id = a.id + 1 WHERE a.form = 'red widget' AND b.form = 'red widget' GROUP BY a.sent),
 k AS (SELECT t.sent, row_number() OVER (PARTITION BY t.sent ORDER BY t.id) AS nid, t.id AS old, t.id AS cover, CASE WHEN t.id = r.a THEN 'red widget_red widget' ELSE t.form END AS form,
   CASE WHEN t.head = r.a + 1 THEN r.a ELSE t.head END AS head FROM tok t LEFT JOIN run r ON r.sent = t.sent WHERE r.a IS NULL OR t.id <> r.a + 1)""",
    edge="CASE WHEN e.h = (SELECT r.a + 1 FROM run r WHERE r.sent = e.sent) THEN e.h - 1 ELSE e.h END",
)


def _kept(v: DataFrame) -> DataFrame:
    done = edit.renumbered(F.filter("words", lambda w: w["xpos"] == "O"), F.col("mwts"), F.col("empties"))
    return v.select("sent", done.alias("done")).select("sent", "done.*")


structure(
    "seq_renumber", _kept,
    "k AS (SELECT sent, row_number() OVER (PARTITION BY sent ORDER BY id) AS nid, id AS old, id AS cover, form, head FROM tok WHERE xpos = 'O')",
)

query(
    "edit_mwt_limits",
    lambda s, d: edit.set_mwt(views.orders(s, d), 1, "both", {"Gloss": "g"}).select("sent", F.inline("mwts")).select("sent", "id", "subid", "form", "upos", tx.misc_text(F.col("misc")).alias("misc")),
    f"{TOK} SELECT DISTINCT sent, 1 AS id, 2 AS subid, 'both' AS form, '_' AS upos, 'Gloss=g' AS misc FROM tok WHERE sent % 3 = 0 AND n > 2",
)

# sentences

query(
    "sent_split",
    lambda s, d: every_token(edit.split_sentence(views.orders(s, d), 3), "sent", "part", "text"),
    f"""{TOK},{PARTS},
 t AS (SELECT *, CASE WHEN n > 3 AND id > 3 THEN 2 ELSE 1 END AS side, CASE WHEN id > 3 THEN 3 ELSE 0 END AS off FROM tok),
 piece AS (SELECT sent, side, id, CASE WHEN n > 3 AND sent % 3 = 0 AND id = 1 THEN form || lead(form) OVER (PARTITION BY sent, side ORDER BY id) || ' '
   WHEN n > 3 AND sent % 3 = 0 AND id = 2 THEN '' ELSE form || ' ' END AS piece FROM t),
 txt AS (SELECT sent, side, rtrim(string_agg(piece, '' ORDER BY id)) AS text FROM piece GROUP BY ALL),
 d AS (SELECT e.sent, e.id, string_agg((CASE WHEN e.h > 0 THEN e.h - t.off ELSE e.h END) || ':' || e.rel, '|' ORDER BY e.o) AS deps
   FROM e JOIN t ON t.sent = e.sent AND t.id = e.id WHERE e.h = 0 OR e.h > t.off GROUP BY ALL)
 SELECT t.sent AS sent, t.side AS part, txt.text AS text, 'WORD' AS kind, t.id - t.off AS id, -1 AS subid, t.form AS form, CASE WHEN t.head > t.off THEN t.head - t.off ELSE 0 END AS head,
   coalesce(d.deps, '_') AS deps FROM t JOIN txt ON txt.sent = t.sent AND txt.side = t.side LEFT JOIN d ON d.sent = t.sent AND d.id = t.id
 UNION ALL SELECT m.sent, 1, text, 'MWT', 1, 2, m.form, -1, '_' FROM mform m JOIN txt ON txt.sent = m.sent AND txt.side = 1
 UNION ALL SELECT sent, 1, text, 'EMPTY', 1, 1, 'gap', -1, '_' FROM txt WHERE side = 1 AND sent % 5 = 0""",
)


def merged_sql(group: str, columns: str) -> str:
    """All tokens of groups of sentences, ids shifted by the words of the group's sentences before."""
    return f"""{TOK},{PARTS}, s AS (SELECT DISTINCT sent, {group} AS grp, n FROM tok),
 o AS (SELECT sent, grp, CAST(coalesce(sum(n) OVER (PARTITION BY grp ORDER BY sent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM s),
 d AS (SELECT e.sent, e.id, string_agg((CASE WHEN e.h > 0 THEN e.h + o.off ELSE e.h END) || ':' || e.rel, '|' ORDER BY e.o) AS deps FROM e JOIN o ON o.sent = e.sent GROUP BY ALL),
 r AS (SELECT grp, t.sent, 'WORD' AS kind, t.id + off AS id, -1 AS subid, t.form, CASE WHEN t.head > 0 THEN t.head + off ELSE t.head END AS head, d.deps
   FROM tok t JOIN o ON o.sent = t.sent JOIN d ON d.sent = t.sent AND d.id = t.id
   UNION ALL SELECT grp, m.sent, 'MWT', 1 + off, 2 + off, form, -1, '_' FROM mform m JOIN o ON o.sent = m.sent
   UNION ALL SELECT grp, sent, 'EMPTY', 1 + off, 1, 'gap', -1, '_' FROM o WHERE sent % 5 = 0)
 SELECT {columns} FROM r"""


query(
    "sent_join",
    lambda s, d: every_token(edit.join_sentences(views.orders(s, d).withColumn("file", F.lit(0)), "file", "sent"), "pair"),
    merged_sql("sent // 2", "grp AS pair, kind, id, subid, form, head, deps"),
)


def _merged(s: SparkSession, d: str) -> DataFrame:
    """Whole sentences are merged, with all that their tokens have; the words before a sentence are those of the sentences that are merged."""
    sents = views.orders(s, d, per=1000).select("grp", "sent", "words", "mwts", "empties")
    return corpus.merged_tokens(sents, "grp", "sent", bounded=True).select("grp", "sent", "kind", "id", "subid", "form", "head", tx.deps_text(F.col("deps")).alias("deps"))


query(
    "merge_all", _merged,
    merged_sql("sent // 1000", "grp, sent, kind, id, subid, form, head, deps"),
)
query(
    "merge_rows",
    lambda s, d: every_token(corpus.merged(views.orders(s, d).withColumn("grp", F.floor(F.col("sent") / 100)), "grp", "sent"), "grp"),
    merged_sql("sent // 100", "grp, kind, id, subid, form, head, deps"),
)

# edits from tables


def _edit_field(s: SparkSession, d: str) -> DataFrame:
    """Two edits of one word of some sentences: the later one counts."""
    rows = views.read(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("sent"), F.lit(1).alias("id"), F.col("o_orderpriority").alias("value"), F.lit(1).alias("at"))
    later = rows.where("sent % 2 = 0").withColumn("value", F.lit("0")).withColumn("at", F.lit(2))
    return edit.edit_fields(views.orders(s, d), rows.unionByName(later), "sent", "lemma", order="at").select("sent", F.inline("words")).select("sent", "id", "lemma")


query(
    "edit_field", _edit_field,
    f"""{TOK} SELECT t.sent AS sent, t.id AS id, CASE WHEN t.id > 1 OR o.o_orderkey IS NULL THEN t.lemma WHEN t.sent % 2 = 0 THEN '0' ELSE o.o_orderpriority END AS lemma
 FROM tok t LEFT JOIN orders o ON o.o_orderkey = t.sent AND o.o_orderstatus = 'F'""",
)


def _meta_edit(s: SparkSession, d: str) -> DataFrame:
    rows = views.read(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("sent"), F.col("o_orderpriority").alias("text"))
    return edit.set_metadata(views.orders(s, d).select("sent", "text"), rows.unionByName(rows.withColumn("text", F.lit("0"))), "sent", "text").select("sent", "text")


query(
    "meta_edit", _meta_edit,
    f"""{TOK}, x AS (SELECT sent, string_agg(form, ' ' ORDER BY id) AS text FROM tok GROUP BY sent)
 SELECT x.sent AS sent, CASE WHEN o.o_orderkey IS NULL THEN x.text ELSE greatest(o.o_orderpriority, '0') END AS text FROM x LEFT JOIN orders o ON o.o_orderkey = x.sent AND o.o_orderstatus = 'P'""",
)


def _lock(s: SparkSession, d: str) -> DataFrame:
    """Edits against an old or the current version; some keys have two against the current one, of which one gets in."""
    orders = views.read(s, d, "orders")
    current = orders.select("o_orderkey", (F.col("o_orderkey") % 4).alias("version"), F.col("o_orderstatus").alias("value"))
    edits = orders.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_orderkey") % 2).alias("version"), F.lit("E").alias("value"))
    return edit.merge_if_current(current, edits.unionByName(edits.where("o_orderkey % 3 = 0").withColumn("value", F.lit("D"))), "o_orderkey", "version", "value")


query(
    "optimistic_lock", _lock,
    """WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS version, o_orderstatus AS value, o_orderstatus = 'F' AS edited, o_orderstatus = 'F' AND o_orderkey % 4 = o_orderkey % 2 AS won,
   CASE WHEN o_orderstatus <> 'F' THEN 0 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS n FROM orders)
 SELECT o_orderkey, version + CASE WHEN won THEN 1 ELSE 0 END AS version, CASE WHEN won AND n = 2 THEN 'D' WHEN won THEN 'E' ELSE value END AS value,
   CAST(n - CASE WHEN won THEN 1 ELSE 0 END AS BIGINT) AS refused FROM o""",
)


def _highlight(s: SparkSession, d: str) -> DataFrame:
    rows = edit.highlight(edit.highlight(views.orders(s, d), c.upos("R")), c.deprel("dep1"), "labels")
    rows = rows.withColumn("comments", F.array(F.lit("highlight tokens = 9"), F.lit("note")))
    rows = edit.highlight_comments(rows, "highlighted", "labels")
    return rows.select("sent", F.array_join("comments", "+").alias("comments"), F.array_join(edit.highlighted(rows, "deprels"), ",").alias("labels"))


query(
    "highlight_edit", _highlight,
    f"""{TOK}, h AS (SELECT sent, string_agg(CASE WHEN upos = 'R' THEN CAST(id AS VARCHAR) END, ' ' ORDER BY id) AS t, string_agg(CASE WHEN deprel = 'dep1' THEN CAST(id AS VARCHAR) END, ' ' ORDER BY id) AS l
   FROM tok GROUP BY sent)
 SELECT sent, coalesce('highlight deprels = ' || l || '+', '') || coalesce('highlight tokens = ' || t || '+', '') || 'note' AS comments, coalesce(replace(l, ' ', ','), '') AS labels FROM h""",
)

# patterns over words, empty words and the root


def bindings(name: str, p: grew.Pattern, sql: str) -> None:
    def full_id(n: str) -> F.Column:
        return F.concat_ws(".", F.col(n)["id"], F.when(F.col(n)["subid"] > 0, F.col(n)["subid"])).alias(n.lower())

    PATTERNS[name] = p
    query(name, lambda s, d: grew.match(views.orders(s, d), p, "sent").select("sent", *map(full_id, p.nodes)), f"{TOK} {sql}")


bindings("grew_domain", grew.Pattern({"E": c.upos("E"), "W": c.xpos("O")}, order=[("E", "W", True)]), "SELECT sent, '1.1' AS e, CAST(id AS VARCHAR) AS w FROM tok WHERE sent % 5 = 0 AND id = 2 AND xpos = 'O'")
bindings("grew_edge", grew.Pattern({"B": c.upos("R")}, [("A", "B")]), "SELECT sent, CAST(head AS VARCHAR) AS a, CAST(id AS VARCHAR) AS b FROM tok WHERE upos = 'R'")
bindings(
    "grew_without_node", grew.Pattern({"V": c.upos("N")}, without=[[grew.Is("V", c.lemma("PROMO"))], [("V", "X"), grew.Is("X", c.xpos("O")), ("X", "Y", ["dep2"])]]),
    """SELECT sent, CAST(id AS VARCHAR) AS v FROM tok t WHERE upos = 'N' AND lemma <> 'PROMO' AND NOT EXISTS
   (SELECT 1 FROM tok x JOIN tok y ON y.sent = x.sent AND y.head = x.id WHERE x.sent = t.sent AND x.head = t.id AND x.xpos = 'O' AND y.deprel = 'dep2')""",
)
