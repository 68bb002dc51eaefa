"""Updates: rules over all tokens, edits by key, and structural edits. All return new sentence rows; nothing mutates.

A rule sees the sentence as it was before the rule (a snapshot), or, in sequence, what it has made of the words before; the next rule
sees what the last one made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Cond
from ..functions.let import let, looking_at, settled, the_words
from ..functions.text import surface
from ..functions.values import Value, literal
from .trees import ancestors

PLAIN = ("upos", "xpos", "lemma", "form", "deprel")


@dataclass
class Rule:
    """Where the condition holds, set columns: upos, xpos, lemma, form, deprel, headid ("3", "+1", "-2"), Feat_X, Misc_X, eud ("+1:obj");
    an empty Feat_ or Misc_ value deletes the name, "_" for feats, misc or eud clears all of it."""

    cond: Cond
    to: dict[str, Value | str]


def _value(v: Value | str) -> Value:
    return literal(v) if isinstance(v, str) else v


def _put(pairs: Column, key: str, val: Column) -> Column:
    """Pairs with the key set to val; without it where val is empty."""
    field = F.struct(F.lit(key).alias("key"), val.alias("val"))
    kept = F.transform(pairs, lambda m: F.when(m["key"] == key, field).otherwise(m))
    there = F.exists(pairs, lambda m: m["key"] == key)
    return F.when(val == "", F.filter(pairs, lambda m: m["key"] != key)).when(there, kept).otherwise(F.concat(pairs, F.array(field)))


def new_head(t: Column, wanted: Column) -> tuple[Column, Column]:
    """(head, warning) for a wanted head, absolute or signed: unchanged, with a warning, if outside, itself or below the token."""
    n = wanted.try_cast("int")
    to = F.when(wanted.rlike(r"\A[+-]"), t["id"] + n).otherwise(n)
    below = F.array_contains(ancestors(F.get(the_words(), to - 1)), t["id"])
    why = (
        F.when(to.isNull(), "head is no number").when((to < 0) | (to > F.size(the_words())), "head is outside the sentence")
        .when(to == t["id"], "head is the word itself").when((to > 0) & F.coalesce(below, F.lit(False)), "head is below the word")
    )
    return F.when(why.isNull(), to).otherwise(t["head"]), why


def _other_than(name: str):
    return lambda k, _: F.lower(k) != name


def _where(hits: str, rule: Rule):
    return lambda t, i: F.when(F.get(F.col(hits), i), _applied(t, rule)).otherwise(t)


def _applied(t: Column, rule: Rule) -> Column:
    out = t
    for name, v in rule.to.items():
        val, low = _value(v)(out), name.lower()
        if low in PLAIN:
            out = out.withField(low, val)
        elif low == "headid":
            out = out.withField("head", new_head(out, val)[0])
        elif low.startswith("feat_"):
            rest = F.map_filter(out["feats"], _other_than(low[5:]))
            out = out.withField("feats", F.when(val == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name[5:]), val))))
        elif low.startswith("misc_"):
            out = out.withField("misc", _put(out["misc"], name[5:], val))
        elif low == "feats":
            out = out.withField("feats", F.map_filter(out["feats"], lambda k, v_: F.lit(False)))
        elif low == "misc":
            out = out.withField("misc", F.slice(out["misc"], 1, 0))
        elif low == "eud":
            at = F.substring_index(val, ":", 1)
            to = F.when(at.rlike(r"\A[+-]"), out["id"] + at.try_cast("int")).otherwise(at.try_cast("int"))
            edge = F.struct(to.cast("int").alias("headid"), F.lit(-1).alias("headsubid"), F.substring(val, F.instr(val, ":") + 1, F.length(val)).alias("deprel"))
            out = out.withField("deps", F.when(val == "_", F.slice(out["deps"], 1, 0)).otherwise(F.concat(out["deps"], F.array(edge))))
        else:
            raise ValueError(f"no such column: {name}")
    return out


def apply_rules(sents: DataFrame, rules: list[Rule], kind: str = "words", sequential: bool = False) -> DataFrame:
    """sents after all rules, and `changes`: how many tokens the rules' conditions held for, by rule.

    With `sequential` a rule goes through the words from left to right, and its condition and values see the words before as the rule has left them; that is a
    fold over the words whose state is the sentence."""
    if sequential and kind != "words":
        raise ValueError("only words are gone through in sequence")
    hits = []
    for k, rule in enumerate(rules):
        if sequential:
            sents = settled(sents.withColumn(f"hit{k}_", _in_sequence(rule)), f"hit{k}_")
            sents = sents.withColumn("words", F.col(f"hit{k}_.words"))
            hits.append(F.col(f"hit{k}_.n"))
            continue
        # settled: a condition inside the lambda that asks for it would be tested for all words again for each of them
        sents = settled(sents.withColumn(f"hit{k}_", F.transform(kind, rule.cond.__call__)), f"hit{k}_")
        sents = settled(sents.withColumn(kind, F.transform(kind, _where(f"hit{k}_", rule))), kind)
        hits.append(F.size(F.filter(f"hit{k}_", lambda x: x)))
    out = sents.withColumn("changes", F.array(*hits))
    return out.drop(*(f"hit{k}_" for k in range(len(rules))))


def _in_sequence(rule: Rule) -> Column:
    """(words, n): the words after the rule has gone through them one by one, and how many it held for."""
    def step(acc: Column, i: Column) -> Column:
        words = acc["words"]

        def one(t: Column) -> Column:
            with looking_at(words):
                hit, new = rule.cond(t), _applied(t, rule)
            put = F.concat(F.slice(words, F.lit(1), i - 1), F.array(new), F.slice(words, i + 1, F.size(words)))
            return F.when(hit, F.struct(put.alias("words"), (acc["n"] + 1).alias("n"))).otherwise(acc)

        return let(F.get(words, i - 1), then=one)

    start = F.struct(F.col("words").alias("words"), F.lit(0).alias("n"))
    return F.when(F.size("words") > 0, F.aggregate(F.sequence(F.lit(1), F.size("words")), start, step)).otherwise(start)


def edit_fields(sents: DataFrame, edits: DataFrame, key: str, field: str, order: str | None = None) -> DataFrame:
    """Sets a field of words named by an edits table (key, id, value): one join, edits of a sentence in one map. Of several edits of one
    word the last counts: the one with the largest `order`, or, without such a column, with the largest value."""
    value = F.max_by("value", order) if order else F.max("value")
    one = edits.where("id is not null").groupBy(key, "id").agg(value.alias("value"))
    by = one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "value")))).alias("edits_"))
    rows = settled(sents.join(by, key, "left"), "edits_")
    set_ = lambda w: w.withField(field, F.coalesce(F.try_element_at("edits_", w["id"]), w[field]))
    return rows.withColumn("words", F.when(F.col("edits_").isNull(), F.col("words")).otherwise(F.transform("words", set_))).drop("edits_")


def reattach(sents: DataFrame, word: int, to: int, rel: str | None = None) -> DataFrame:
    """Moves a word to a new head; `warning` says why where that is refused."""
    t = F.get("words", F.lit(word - 1))
    head, why = new_head(t, F.lit(str(to)))

    def moved(head: Column, why: Column) -> Column:
        set_ = lambda w: w.withField("head", head).withField("deprel", w["deprel"] if rel is None else F.lit(rel))
        words = F.transform("words", lambda w: F.when((w["id"] == word) & why.isNull(), set_(w)).otherwise(w))
        return F.struct(words.alias("words"), why.alias("warning"))

    done = F.when(t.isNotNull(), let(head, why, then=moved)).otherwise(F.struct(F.col("words"), F.lit(None).cast("string").alias("warning")))
    return sents.withColumn("done_", done).withColumn("words", F.col("done_.words")).withColumn("warning", F.col("done_.warning")).drop("done_")


def add_enhanced(sents: DataFrame, word: int, head: int, rel: str) -> DataFrame:
    edge = F.struct(F.lit(head).alias("headid"), F.lit(-1).alias("headsubid"), F.lit(rel).alias("deprel"))
    return sents.withColumn("words", F.transform("words", lambda w: F.when((w["id"] == word) & ~F.array_contains(w["deps"], edge), w.withField("deps", F.concat(w["deps"], F.array(edge)))).otherwise(w)))


def drop_enhanced(sents: DataFrame, word: int, head: int, rel: str) -> DataFrame:
    return sents.withColumn("words", F.transform("words", lambda w: F.when(w["id"] == word, w.withField("deps", F.filter(w["deps"], lambda d: ~((d["headid"] == head) & (d["deprel"] == rel))))).otherwise(w)))


#: The id of a word that is put in; one that is split off word n has the id -n until words are numbered.
NEW = -1_000_000


def renumbered(words: Column, mwts: Column, empties: Column) -> Column:
    """(words, mwts, empties) with ids 1 to n in the order of `words`, and everything that names ids with them.

    Heads follow (0 where the head is gone), enhanced edges follow (those of gone heads go), also edges from empty words. A multiword token
    covers what is left of its words, what was split off them and what was put in between; it goes if that is one word or none. An empty word
    stays behind the word that it stood behind, or the nearest before that is left, and is numbered among the others there.
    """
    def numbered(words: Column, mwts: Column, empties: Column, ids: Column, gaps: Column) -> Column:
        at = lambda h: F.array_position(ids, h).cast("int")

        def gap(d: Column) -> Column:  # the new number of the empty word that an edge comes from
            return F.get(F.filter(gaps, lambda g: (g["id"] == d["headid"]) & (g["sub"] == d["headsubid"])), F.lit(0))

        def edge(d: Column) -> Column:
            real = d.withField("headid", F.when(d["headid"] > 0, at(d["headid"])).otherwise(d["headid"]))
            return F.when(d["headsubid"] < 0, real).otherwise(d.withField("headid", gap(d)["to"]).withField("headsubid", gap(d)["tosub"]))

        def there(d: Column) -> Column:
            return F.when(d["headsubid"] < 0, (d["headid"] <= 0) | (at(d["headid"]) > 0)).otherwise(gap(d).isNotNull())

        edges = lambda t: F.transform(F.filter(t["deps"], there), edge)
        word = lambda w, i: w.withField("id", (i + 1).cast("int")).withField("head", F.when(w["head"] > 0, at(w["head"])).otherwise(w["head"])).withField("deps", edges(w))
        covered = lambda m: F.filter(F.transform(ids, lambda x, i: F.when(F.abs(x).between(m["id"], m["subid"]), i + 1)), lambda i: i.isNotNull())
        token = lambda m: m.withField("id", F.array_min(covered(m)).cast("int")).withField("subid", F.array_max(covered(m)).cast("int"))
        empty = lambda e, i: e.withField("id", F.get(gaps, i)["to"]).withField("subid", F.get(gaps, i)["tosub"]).withField("deps", edges(e))
        return F.struct(
            F.transform(words, word).alias("words"), F.filter(F.transform(mwts, token), lambda m: m["subid"] > m["id"]).alias("mwts"),
            F.transform(empties, empty).alias("empties"),
        )

    def with_gaps(words: Column, mwts: Column, empties: Column, ids: Column) -> Column:
        before = lambda n: F.coalesce(F.array_max(F.transform(ids, lambda x, i: F.when(F.abs(x) <= n, i + 1))), F.lit(0)).cast("int")
        to = F.transform(empties, lambda e: F.struct(e["id"].alias("id"), e["subid"].alias("sub"), before(e["id"]).alias("to")))
        among = lambda to: F.transform(to, lambda g, i: F.struct(g["id"], g["sub"], g["to"], F.size(F.filter(F.slice(to, F.lit(1), i + 1), lambda x: x["to"] == g["to"])).alias("tosub")))
        return let(let(to, then=among), then=lambda gaps: numbered(words, mwts, empties, ids, gaps))

    def with_ids(words: Column, mwts: Column, empties: Column) -> Column:
        return let(F.transform(words, lambda w: w["id"]), then=lambda ids: with_gaps(words, mwts, empties, ids))

    order = lambda a, b: F.when(a["id"] != b["id"], a["id"] - b["id"]).otherwise(a["subid"] - b["subid"])
    return let(words, mwts, F.array_sort(empties, order), then=with_ids)


def _restructured(sents: DataFrame, words: Column, allowed: Column) -> DataFrame:
    """sents with the sentence's tokens renumbered after `words`, where that is allowed; columns that sents doesn't have aren't made."""
    columns = ("words", "mwts", "empties")
    own = [F.col(c) if c in sents.columns else F.slice("words", 1, 0) for c in columns]
    as_is = F.struct(*(x.alias(c) for c, x in zip(columns, own, strict=True)))
    done = sents.withColumn("done_", F.when(F.coalesce(allowed, F.lit(False)), renumbered(words, own[1], own[2])).otherwise(as_is))
    done = settled(done, "done_")
    return done.withColumns({c: F.col(f"done_.{c}") for c in columns if c in sents.columns}).drop("done_")


def renumber(words: Column) -> Column:
    """Words alone, numbered as `renumbered` does."""
    return renumbered(words, F.slice(words, 1, 0), F.slice(words, 1, 0))["words"]


def _blank(w: Column, form: str | Column) -> Column:
    """A token like w with this form and nothing else."""
    out = w
    for f in ("lemma", "upos", "xpos", "deprel"):
        out = out.withField(f, F.lit("_"))
    out = out.withField("form", F.lit(form) if isinstance(form, str) else form).withField("head", F.lit(-1))
    return out.withField("feats", F.map_filter(w["feats"], lambda k, v: F.lit(False))).withField("deps", F.slice(w["deps"], 1, 0)).withField("misc", F.slice(w["misc"], 1, 0))


def _upto(n: int) -> Column:
    return F.slice("words", F.lit(1), F.lit(n)) if n else F.slice("words", 1, 0)


def _from(n: int) -> Column:
    return F.slice("words", F.lit(n), F.greatest(F.size("words"), F.lit(0)))


def delete_word(sents: DataFrame, word: int) -> DataFrame:
    """Without the word; its dependents go to its head, enhanced edges from it go. A sentence's only word stays."""
    gone = F.get("words", F.lit(word - 1))
    moved = lambda w: F.when(w["head"] == word, w.withField("head", gone["head"])).otherwise(w)
    kept = F.transform(F.filter("words", lambda w: w["id"] != word), moved)
    return _restructured(sents, kept, gone.isNotNull() & (F.size("words") > 1))


def insert_word(sents: DataFrame, after: int, form: str, lemma: str = "_", upos: str = "_", xpos: str = "_") -> DataFrame:
    """A word after place `after` (0: in front), attached to the word before it, or to the first if in front."""
    new = _blank(F.get("words", F.lit(0)), form).withField("lemma", F.lit(lemma)).withField("upos", F.lit(upos)).withField("xpos", F.lit(xpos))
    new = new.withField("head", F.lit(max(after, 1)).cast("int")).withField("deprel", F.lit("dep")).withField("id", F.lit(NEW))
    return _restructured(sents, F.concat(_upto(after), F.array(new), _from(after + 1)), F.size("words") >= max(after, 1))


def join_words(sents: DataFrame, word: int) -> DataFrame:
    """Joins a word with the next: the one nearer the root stays (the left one in a tie), forms and lemmas concatenated; what
    depends on the other one, in the tree or by enhanced edges, goes to it."""
    a, b = F.get("words", F.lit(word - 1)), F.get("words", F.lit(word))
    right = F.size(ancestors(b)) < F.size(ancestors(a))

    def joined(keep: Column, drop: Column) -> Column:
        edge = lambda d: d.withField("headid", F.when((d["headid"] == drop) & (d["headsubid"] < 0), keep).otherwise(d["headid"]))

        def one(w: Column) -> Column:
            own = F.filter(F.transform(w["deps"], edge), lambda d: (d["headid"] != w["id"]) | (d["headsubid"] >= 0))
            both = w.withField("form", F.concat(a["form"], b["form"])).withField("lemma", F.concat(a["lemma"], b["lemma"]))
            up = F.when(w["head"] == drop, F.get("words", drop - 1)["head"]).otherwise(w["head"])
            moved = w.withField("head", F.when(w["head"] == drop, keep).otherwise(w["head"]))
            # not set on the choice of both: a choice would be made again for each field
            return F.when(w["id"] == keep, both.withField("head", up).withField("deps", own)).otherwise(moved.withField("deps", own))

        return F.transform(F.filter("words", lambda w: w["id"] != drop), one)

    ids = lambda right: let(F.when(right, b["id"]).otherwise(a["id"]), F.when(right, a["id"]).otherwise(b["id"]), then=joined)
    return _restructured(sents, let(right, then=ids), b.isNotNull())


def split_word(sents: DataFrame, word: int, at: int) -> DataFrame:
    """Splits a word's form and lemma at a character; the second part depends on the first."""
    w0 = F.get("words", F.lit(word - 1))
    left = w0.withField("form", F.substring(w0["form"], 1, at)).withField("lemma", F.substring(w0["lemma"], 1, at))
    rest = lambda x: F.substring(x, F.lit(at + 1), F.length(x))
    right = _blank(w0, rest(w0["form"])).withField("lemma", rest(w0["lemma"])).withField("upos", w0["upos"]).withField("xpos", w0["xpos"]).withField("feats", w0["feats"])
    right = right.withField("id", F.lit(-word)).withField("head", F.lit(word)).withField("deprel", F.lit("fixed"))
    return _restructured(sents, F.concat(_upto(word - 1), F.array(left, right), _from(word + 1)), F.length(w0["form"]) > at)


def split_to_mwt(sents: DataFrame, word: int, forms: list[str], lemmas: list[str] | None = None) -> DataFrame:
    """A word becomes a multiword token of its form over words with these forms: the first keeps the word's annotation and MISC goes to the token; the
    others depend on the first. A word that a multiword token covers already stays as it is."""
    w0 = F.get("words", F.lit(word - 1))
    parts = [w0.withField("form", F.lit(forms[0])).withField("misc", F.slice(w0["misc"], 1, 0))]
    parts += [_blank(w0, f).withField("id", F.lit(-word)).withField("head", F.lit(word)).withField("deprel", F.lit("fixed")) for f in forms[1:]]
    if lemmas:
        parts = [p.withField("lemma", F.lit(x)) for p, x in zip(parts, lemmas, strict=True)]
    free = w0.isNotNull() & ~F.exists("mwts", lambda m: F.lit(word).between(m["id"], m["subid"])) & F.lit(len(forms) > 1)
    token = _blank(w0, w0["form"]).withField("kind", F.lit("MWT")).withField("subid", F.lit(word)).withField("misc", w0["misc"])
    order = lambda a, b: a["id"] - b["id"]
    with_token = sents.withColumn("free_", F.coalesce(free, F.lit(False)))
    with_token = with_token.withColumn("mwts", F.when(F.col("free_"), F.array_sort(F.concat("mwts", F.array(token)), order)).otherwise(F.col("mwts")))
    with_token = settled(with_token, "mwts")
    return _restructured(with_token, F.concat(_upto(word - 1), F.array(*parts), _from(word + 1)), F.col("free_")).drop("free_")


def set_mwt(sents: DataFrame, first: int, form: str | None = None, misc: dict[str, str] | None = None) -> DataFrame:
    """Sets form and MISC values of the multiword token that begins with this word: nothing else of one can be set."""
    def one(m: Column) -> Column:
        out = m if form is None else m.withField("form", F.lit(form))
        for k, v in (misc or {}).items():
            out = out.withField("misc", _put(out["misc"], k, F.lit(v)))
        return F.when(m["id"] == first, out).otherwise(m)

    return sents.withColumn("mwts", F.transform("mwts", one))


def compose_mwt(sents: DataFrame, first: int, last: int, form: str | None = None) -> DataFrame:
    """A multiword token over words first to last, unless one overlaps it."""
    free = ~F.exists("mwts", lambda m: (m["id"] <= last) & (m["subid"] >= first)) & (F.size("words") >= last)
    forms = F.array_join(F.transform(F.slice("words", first, last - first + 1), lambda x: x["form"]), "") if form is None else F.lit(form)
    m = _blank(F.get("words", F.lit(first - 1)), forms).withField("kind", F.lit("MWT")).withField("subid", F.lit(last))
    return sents.withColumn("mwts", F.when(free, F.array_sort(F.concat("mwts", F.array(m)), lambda a, b: a["id"] - b["id"])).otherwise(F.col("mwts")))


def drop_mwt(sents: DataFrame, first: int) -> DataFrame:
    return sents.withColumn("mwts", F.filter("mwts", lambda m: m["id"] != first))


def insert_empty(sents: DataFrame, after: int, form: str) -> DataFrame:
    """An empty word n.m after word n, the next free m."""
    m = F.coalesce(F.array_max(F.transform(F.filter("empties", lambda e: e["id"] == after), lambda e: e["subid"])), F.lit(0)) + 1
    e = _blank(F.get("words", F.lit(0)), form).withField("kind", F.lit("EMPTY")).withField("id", F.lit(after)).withField("subid", m)
    order = lambda a, b: F.when(a["id"] != b["id"], a["id"] - b["id"]).otherwise(a["subid"] - b["subid"])
    return sents.withColumn("empties", F.when(F.size("words") >= after, F.array_sort(F.concat("empties", F.array(e)), order)).otherwise(F.col("empties")))


def drop_empty(sents: DataFrame, word: int, sub: int) -> DataFrame:
    return sents.withColumn("empties", F.filter("empties", lambda e: ~((e["id"] == word) & (e["subid"] == sub))))


def split_sentence(sents: DataFrame, at: int, part: str = "part") -> DataFrame:
    """Two rows for sentences longer than `at` words. Words, multiword tokens and empty words go to their part with new ids; relations across the cut
    become 0, enhanced edges and multiword tokens across it go. `text`, if there is one, is made anew, and a second part's `sent_id` ends in -bis."""
    columns = [c for c in ("words", "mwts", "empties") if c in sents.columns]

    def piece(first: bool) -> Column:
        mine = lambda n: (n <= at) if first else (n > at)
        shift = lambda n: n if first else n - at
        inside = lambda d: (d["headid"] == 0) & (d["headsubid"] < 0) | mine(d["headid"])
        edge = lambda d: d.withField("headid", F.when(d["headid"] > 0, shift(d["headid"])).otherwise(d["headid"]))
        edges = lambda t: F.transform(F.filter(t["deps"], inside), edge)
        head = lambda w: F.when(w["head"] < 1, w["head"]).when(mine(w["head"]), shift(w["head"])).otherwise(0)
        word = lambda w: w.withField("id", shift(w["id"])).withField("head", head(w)).withField("deps", edges(w))
        out = {
            "words": F.transform(F.filter("words", lambda w: mine(w["id"])), word),
            "mwts": F.transform(F.filter("mwts", lambda m: mine(m["id"]) & mine(m["subid"])), lambda m: m.withField("id", shift(m["id"])).withField("subid", shift(m["subid"]))),
            "empties": F.transform(F.filter("empties", lambda e: mine(e["id"])), lambda e: e.withField("id", shift(e["id"])).withField("deps", edges(e))),
        }
        return F.struct(F.lit(1 if first else 2).alias(part), *(out[c].alias(c) for c in columns))

    whole = F.struct(F.lit(1).alias(part), *columns)
    both = F.when(F.size("words") > at, F.array(piece(True), piece(False))).otherwise(F.array(whole))
    rows = sents.withColumn("cut_", F.size("words") > at)
    rows = rows.select(*(c for c in sents.columns if c not in (*columns, part)), "cut_", F.inline(both))
    if "text" in sents.columns:
        made = surface() if "mwts" in columns else F.array_join(F.transform("words", lambda w: w["form"]), " ")
        rows = rows.withColumn("text", F.when(F.col("cut_"), made).otherwise(F.col("text")))
    if "sent_id" in sents.columns:
        rows = rows.withColumn("sent_id", F.when(F.col(part) == 2, F.concat("sent_id", F.lit("-bis"))).otherwise(F.col("sent_id")))
    return rows.drop("cut_")


def join_sentences(sents: DataFrame, group: str, position: str) -> DataFrame:
    """Each sentence with an even position joined with the next of its group, as `merged` does: (group, pair, words, ...)."""
    from .corpus import merged

    pairs = sents.withColumn("pair_", F.struct(group, F.floor(F.col(position) / 2).alias("pair")))
    out = merged(pairs, "pair_", position)
    return out.select(f"pair_.{group}", "pair_.pair", *(c for c in out.columns if c != "pair_"))


def set_metadata(sents: DataFrame, edits: DataFrame, key: str, *names: str, order: str | None = None) -> DataFrame:
    """Sentence columns from an edits table where it has a value; of several edits of one sentence the last one with a value counts (by the
    column `order`, or the largest value)."""
    last = lambda n: F.max_by(n, F.when(F.col(n).isNotNull(), F.col(order))) if order else F.max(n)
    e = edits.groupBy(key).agg(*(last(n).alias(f"{n}_new") for n in names))
    return sents.join(e, key, "left").withColumns({n: F.coalesce(f"{n}_new", n) for n in names}).drop(*(f"{n}_new" for n in names))


def highlight_comments(sents: DataFrame, tokens: str | None = "highlighted", labels: str | None = None) -> DataFrame:
    """sents whose comments have the ids in these columns as `highlight tokens` and `highlight deprels`; earlier ones of the two kinds go."""
    made = [F.when(F.size(c) > 0, F.concat(F.lit(f"highlight {what} = "), F.array_join(F.transform(c, lambda i: i.cast("string")), " "))) for c, what in ((labels, "deprels"), (tokens, "tokens")) if c]
    rest = F.filter("comments", lambda c: ~c.rlike(r"\Ahighlight (tokens|deprels)\s*="))
    return sents.withColumn("comments", F.concat(F.filter(F.array(*made), lambda c: c.isNotNull()), rest))


def highlighted(sents: DataFrame, what: str = "tokens") -> Column:
    """The ids that a highlight comment names, tokens or deprels."""
    notes = F.filter("comments", lambda c: c.rlike(rf"\Ahighlight {what}\s*="))
    return F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(F.get(notes, F.lit(0)), F.lit("")), r"\A[^=]*=", "")), r"\s+"), lambda x: x != "")


def highlight(sents: DataFrame, c: Cond, name: str = "highlighted") -> DataFrame:
    """The ids of the words that satisfy a condition, in a column of the sentence."""
    return sents.withColumn(name, F.transform(F.filter("words", lambda w: c(w)), lambda w: w["id"]))


def highlights_from_messages(messages: DataFrame, pattern: str = r"Sent (\S+) Node (\d+)", column: str = "message") -> DataFrame:
    """sent_id, highlight tokens comment: from a validator's messages that name a sentence and a node."""
    found = messages.select(F.regexp_extract(column, pattern, 1).alias("sent_id"), F.regexp_extract(column, pattern, 2).alias("node")).where("node <> ''")
    ids = found.groupBy("sent_id").agg(F.array_sort(F.collect_set(F.col("node").cast("int"))).alias("ids"))
    return ids.select("sent_id", F.concat(F.lit("highlight tokens = "), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")).alias("comment"))


def latest(versions: DataFrame, key: str, version: str, value: str, undo: int = 0) -> DataFrame:
    """Each sentence's newest version, or the one `undo` steps before it (the oldest if there are fewer)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(F.col(version).desc())
    n = F.count("*").over(W.partitionBy(key))
    return versions.withColumn("k_", F.row_number().over(w)).withColumn("n_", n).where(F.col("k_") == F.least(F.lit(undo + 1), "n_")).select(key, version, value)


def merge_if_current(current: DataFrame, edits: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """Optimistic locking: (key, version, value, refused). An edit made against the current version replaces the value and raises the version; others
    are refused. Of several such edits of one key one wins (that with the least value, so reruns agree). `refused` is the number of edits that didn't get in."""
    e = edits.select(F.col(key).alias("key_"), F.col(version).alias("seen_"), F.col(value).alias("new_"))
    e = current.select(F.col(key).alias("key_"), F.col(version).alias("now_")).join(e, "key_")
    won = F.min(F.when(F.col("seen_") == F.col("now_"), F.struct("new_")))
    e = e.groupBy("key_").agg(won.alias("won_"), F.count("*").alias("n_"))
    rows = current.join(e, current[key] == e["key_"], "left")
    ok = F.col("won_").isNotNull()
    out = F.when(ok, F.col(version) + 1).otherwise(F.col(version)).alias(version), F.when(ok, F.col("won_.new_")).otherwise(F.col(value)).alias(value)
    return rows.select(key, *out, (F.coalesce("n_", F.lit(0)) - ok.cast("int")).cast("long").alias("refused"))


def replace_next(sents: DataFrame, rule: Rule, position: str, current: int) -> DataFrame:
    """The next sentence after a position in which the rule's condition holds, with the rule applied."""
    from .search import after

    return apply_rules(after(sents.where(F.exists("words", rule.cond.__call__)), position, current), [rule])


def compact(sents: DataFrame, forms: list[str], joint: str = "_") -> DataFrame:
    """The first run of words with these forms as one word: the run's word nearest the root stays, forms are joined."""
    n = len(forms)

    def run(w: Column) -> Column:
        out = F.lit(True)
        for k, f in enumerate(forms):
            out = out & F.coalesce(F.get("words", w["id"] - 1 + k)["form"] == f, F.lit(False))
        return out

    first = F.get(F.transform(F.filter("words", run), lambda w: w["id"]), F.lit(0))

    def joined(a: Column) -> Column:
        part = F.slice("words", a, F.lit(n))
        inside = lambda i: i.between(a, a + n - 1)
        top = F.get(F.transform(F.filter(part, lambda w: ~inside(w["head"])), lambda w: w["id"]), F.lit(0))

        def done(top: Column) -> Column:
            kept = F.filter("words", lambda w: ~inside(w["id"]) | (w["id"] == top))
            text = F.array_join(F.transform(part, lambda w: w["form"]), joint)
            edge = lambda d: d.withField("headid", F.when(inside(d["headid"]) & (d["headsubid"] < 0), top).otherwise(d["headid"]))
            own = lambda w: F.filter(F.transform(w["deps"], edge), lambda d: (d["headid"] != w["id"]) | (d["headsubid"] >= 0))
            head = lambda w: F.when(inside(w["head"]) & (w["id"] != top), top).otherwise(w["head"])
            form = lambda w: F.when(w["id"] == top, text).otherwise(w["form"])
            return F.transform(kept, lambda w: w.withField("form", form(w)).withField("head", head(w)).withField("deps", own(w)))

        return let(top, then=done)

    return _restructured(sents, let(first, then=joined), first.isNotNull())


def set_comments(sents: DataFrame, edits: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Comments from an edits table (key, comment: lines), where it has some; of several edits of one sentence the last one with a comment counts
    (by the column `order`, or the largest comment)."""
    last = F.max_by("comment", F.when(F.col("comment").isNotNull(), F.col(order))) if order else F.max("comment")
    e = edits.groupBy(key).agg(last.alias("new_"))
    return sents.join(e, key, "left").withColumn("comments", F.coalesce(F.split("new_", "\n"), "comments")).drop("new_")
