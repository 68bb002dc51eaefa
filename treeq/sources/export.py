"""Sentences in other formats, as text or JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from ..operators import trees
from ..operators.trees import ancestors


def sd_parse() -> Column:
    """A token line, then rel(head-n, dep-n) for each word that has a head."""
    named = lambda w: F.concat(w["form"], F.lit("-"), w["id"].cast("string"))
    arc = lambda words: lambda w: F.concat(w["deprel"], F.lit("("), named(F.get(words, w["head"] - 1)), F.lit(", "), named(w), F.lit(")"))
    arcs = lambda words: F.transform(F.filter(words, lambda w: w["head"] > 0), arc(words))
    return let(F.col("words"), then=lambda words: F.concat_ws("\n", F.array_join(F.transform(words, lambda w: w["form"]), " "), F.array_join(arcs(words), "\n")))


def _spacy_tokens() -> Column:
    head = lambda w: F.when(w["head"] > 0, w["head"] - w["id"]).otherwise(0)
    return F.transform("words", lambda w: F.struct(
        (w["id"] - 1).alias("id"), head(w).alias("head"), w["deprel"].alias("dep"), w["deprel"].alias("tag"), w["form"].alias("orth"), w["lemma"].alias("lemma"), w["upos"].alias("pos")
    ))


def spacy_json() -> Column:
    """{"tokens": [...]}, a sentence, with heads relative to the word; tag holds the label."""
    return F.to_json(F.struct(_spacy_tokens().alias("tokens")))


def spacy_documents(sents: DataFrame, document: str, paragraph: str, position: str) -> DataFrame:
    """(document, json): {"id": ..., "paragraphs": [{"sentences": [{"tokens": [...]}]}]}, sentences in order of position; a document is a row."""
    rows = sents.select(document, paragraph, position, _spacy_tokens().alias("tokens"))
    first = lambda x, y: F.when(x["at"] < y["at"], -1).when(x["at"] > y["at"], 1).otherwise(0)
    parts = rows.groupBy(document, paragraph).agg(F.min(position).alias("at"), F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), "tokens")), first).alias("s"))
    parts = parts.select(document, "at", F.transform("s", lambda x: F.struct(x["tokens"].alias("tokens"))).alias("sentences"))
    docs = parts.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("at", "sentences")), first).alias("p"))
    body = F.transform("p", lambda x: F.struct(x["sentences"].alias("sentences")))
    return docs.select(document, F.to_json(F.struct(F.col(document).alias("id"), body.alias("paragraphs"))).alias("json"))


def tree_json(tokens: Column | None = None, labels: Column | None = None) -> Column:
    """Nodes with their children's ids: a flat form of the tree, since Spark's types don't recurse. A node says `error` where its head is beyond the sentence or it is
    on a cycle; `tokens` and `labels` are arrays of ids whose nodes say that they, or their labels, are highlighted."""
    marked = lambda ids, w: F.lit(False) if ids is None else F.array_contains(ids, w["id"])
    kids = lambda w: F.transform(F.filter("words", lambda c: c["head"] == w["id"]), lambda c: c["id"])
    wrong = lambda w: F.when(w["head"] > F.size("words"), "head beyond the sentence").when(F.array_contains(ancestors(w), w["id"]), "cycle")
    node = lambda w: F.struct(
        w["id"].alias("id"), w["form"].alias("form"), w["upos"].alias("upos"), w["deprel"].alias("deprel"), w["head"].alias("parent"), kids(w).alias("children"),
        wrong(w).alias("error"), F.when(marked(tokens, w), True).alias("highlight"), F.when(marked(labels, w), True).alias("highlight_deprel"),
    )
    return F.to_json(F.transform("words", node))


def _open(text: Column) -> Column:
    """A JSON object without the brace that closes it."""
    return let(text, then=lambda x: F.substring(x, F.lit(1), F.length(x) - 1))


def nested_json(tokens: Column | None = None, labels: Column | None = None, multiword: bool = True) -> Column:
    """Trees as nested JSON: an array of roots, each a node whose `children` are nodes, in order of id.

    A node has id, form, lemma, upos, xpos, and, unless they are empty, feats, misc (name, val), deps (id, deprel), mwe (fromid, toid, form of the multiword token that
    begins there; `multiword` says that sentences have them), deprel, and the marks error (head outside the sentence; cycle, where a cycle is opened at its smallest word), highlight
    and highlight_deprel for the ids in `tokens` and `labels`. Types don't recurse, so the text is put together along a walk around the trees: what stands before a word's
    children at its entry, what closes it at its exit."""
    marked = lambda ids, w: F.lit(None) if ids is None else F.when(F.array_contains(ids, w["id"]), True)
    some = lambda x, made=None: F.when(F.size(x) > 0, x if made is None else made)
    misc = lambda w: F.transform(w["misc"], lambda m: F.struct(m["key"].alias("name"), m["val"].alias("val")))
    source = lambda d: F.concat(d["headid"].cast("string"), F.when(d["headsubid"] >= 0, F.concat(F.lit("."), d["headsubid"].cast("string"))).otherwise(""))
    deps = lambda w: F.transform(w["deps"], lambda d: F.struct(source(d).alias("id"), d["deprel"].alias("deprel")))
    token = lambda w: F.get(F.transform(F.filter("mwts", lambda m: m["id"] == w["id"]), lambda m: F.struct(m["id"].alias("fromid"), m["subid"].alias("toid"), m["form"].alias("form"))), F.lit(0))

    def node(w: Column, m: Column) -> Column:
        wrong = F.when(w["head"] > F.size("words"), "head outside the sentence").when(m["cycle"].isNotNull(), "cycle")
        mwe = [token(w).alias("mwe")] if multiword else []
        whole = F.struct(
            w["id"].alias("id"), w["form"].alias("form"), w["lemma"].alias("lemma"), w["upos"].alias("upos"), w["xpos"].alias("xpos"), some(w["feats"]).alias("feats"),
            some(w["misc"], misc(w)).alias("misc"), some(w["deps"], deps(w)).alias("deps"), *mwe, w["deprel"].alias("deprel"), wrong.alias("error"),
            marked(tokens, w).cast("boolean").alias("highlight"), marked(labels, w).cast("boolean").alias("highlight_deprel"),
        )
        return F.concat(F.when(m["prior"].isNotNull(), ",").otherwise(""), _open(F.to_json(whole)), F.lit(',"children":['))

    def walk(marks: Column) -> Column:
        ends = lambda w, i: let(F.get(marks, i), then=lambda m: F.array(F.struct(m["entry"].alias("at"), node(w, m).alias("text")), F.struct(m["exit"].alias("at"), F.lit("]}").alias("text"))))
        steps = F.sort_array(F.flatten(F.transform("words", ends)))
        return F.concat(F.lit("["), F.array_join(F.transform(steps, lambda s: s["text"]), ""), F.lit("]"))

    return let(trees.labels(), then=walk)


def latex(enhanced: bool = False, rows: tuple[str, ...] = (), mwts: bool = True, right_to_left: bool = False) -> Column:
    """A dependency environment of tikz-dependency: forms, tags and more rows (MISC keys such as Gloss or Translit), edges, multiword tokens as groups of words, enhanced
    edges below. Right to left, words stand in reverse order."""
    safe = lambda x: F.regexp_replace(x, r"([&%$#_{}])", r"\\$1")
    at = (lambda i: F.size("words") + 1 - i) if right_to_left else lambda i: i
    words = F.reverse("words") if right_to_left else F.col("words")
    misc = lambda w, k: F.coalesce(F.get(F.transform(F.filter(w["misc"], lambda m: m["key"] == k), lambda m: m["val"]), F.lit(0)), F.lit(""))
    row = lambda value: F.concat(F.array_join(F.transform(words, lambda w: safe(value(w))), r" \& "), F.lit(r" \\"))
    field = lambda f: (lambda w: w[f])
    key = lambda k: (lambda w: misc(w, k))
    arc = lambda how, h, d, rel: F.when(h > 0, F.format_string(rf"\depedge{how}{{%d}}{{%d}}{{%s}}", at(h), at(d), safe(rel))).otherwise(F.format_string(rf"\deproot{how}{{%d}}{{%s}}", at(d), safe(rel)))
    lines = [F.lit(r"\begin{dependency}"), F.lit(r"\begin{deptext}"), row(field("form")), row(field("upos")), *(row(key(k)) for k in rows), F.lit(r"\end{deptext}")]
    lines.append(F.array_join(F.transform("words", lambda w: arc("", w["head"], w["id"], w["deprel"])), "\n"))
    if enhanced:
        extra = lambda w: F.filter(w["deps"], lambda d: (d["headsubid"] < 0) & ((d["headid"] != w["head"]) | (d["deprel"] != w["deprel"])))
        below = F.flatten(F.transform("words", lambda w: F.transform(extra(w), lambda d: arc("[edge below]", d["headid"], w["id"], d["deprel"]))))
        lines.append(F.nullif(F.array_join(below, "\n"), F.lit("")))
    if mwts:
        group = lambda m: F.format_string(r"\wordgroup{1}{%d}{%d}{w%d}", F.least(at(m["id"]), at(m["subid"])), F.greatest(at(m["id"]), at(m["subid"])), m["id"])
        lines.append(F.nullif(F.array_join(F.transform("mwts", group), "\n"), F.lit("")))
    return F.concat_ws("\n", *lines, F.lit(r"\end{dependency}"))


def plain_text(sents: DataFrame, path: str) -> None:
    """Surface text, a line per sentence."""
    from ..functions.text import surface

    sents.select(surface().alias("value")).write.text(path)
