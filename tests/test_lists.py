import json

from treeq.sources import lists


def test_lists(spark, tmp_path):
    (tmp_path / "upos.txt").write_text("# tags\nNOUN\nVERB\n\nNOUN\n")
    assert sorted(r.value for r in lists.values(spark, str(tmp_path / "upos.txt")).collect()) == ["NOUN", "VERB"]
    (tmp_path / "feats.txt").write_text("Number=Sing\nU:NOUN Case Gender\nX:N Number=Plur\n")
    got = {tuple(r) for r in lists.features(spark, str(tmp_path / "feats.txt")).collect()}
    assert got == {("any", None, "Number", "Sing"), ("upos", "NOUN", "Case", None), ("upos", "NOUN", "Gender", None), ("xpos", "N", "Number", "Plur")}


def test_json(spark, tmp_path):
    feats = {"features": {"xx": {"Case": {"permitted": 1, "uvalues": ["Nom"], "lvalues": ["Foo"], "byupos": {"NOUN": {"Nom": 1, "Foo": 0}}}, "Old": {"permitted": 0, "uvalues": ["A"]}, "Free": {"permitted": 1, "uvalues": ["B"]}}}}
    (tmp_path / "f.json").write_text(json.dumps(feats))
    assert {tuple(r) for r in lists.features_of_json(spark, str(tmp_path / "f.json"), "xx").collect()} == {("NOUN", "Case", "Nom"), ("*", "Free", "B")}
    (tmp_path / "d.json").write_text(json.dumps({"deprels": {"xx": {"obj": {"permitted": 1}, "dep": {"permitted": 0}}}}))
    assert [r.value for r in lists.labels_of_json(spark, str(tmp_path / "d.json"), "xx").collect()] == ["obj"]


def test_rules_of_features(spark, tmp_path):
    """From files to codes: names and values, by UPOS and XPOS, tags without a list, a name that goes with every tag."""
    from treeq.operators.validate import feature_codes
    from treeq.sources.conllu import parse

    (tmp_path / "f.txt").write_text("Number=Sing\nNumber=Plur\nCase=Nom\nU:NOUN Case\nX:N Number\n")
    feats = {"features": {"xx": {"Tense": {"type": "universal", "doc": "global", "permitted": 1, "uvalues": ["Past"], "lvalues": [], "unused_uvalues": ["Fut"]}}}}
    (tmp_path / "g.json").write_text(json.dumps(feats))
    lines = ["NOUN _ Case=Nom", "NOUN _ Number=Sing", "VERB _ Number=Sing", "VERB N Case=Nom", "NOUN _ Case=Acc", "VERB _ Foo=Bar", "NOUN N Tense=Past", "VERB _ Tense=Fut"]
    text = "\n".join(f"{i}\tw\tw\t{u}\t{x}\t{f}\t0\troot\t_\t_" for i, (u, x, f) in enumerate(map(str.split, lines), 1))
    sents = parse(spark.createDataFrame([(text, 1)], "value string, k int"))

    def codes(*paths, **more):
        rules = lists.feature_rules(spark, [str(tmp_path / p) for p in paths], **more)
        return {(r.id, r.code) for r in feature_codes(sents, rules, "k").collect()}

    assert codes("f.txt") == {(2, 1), (4, 1), (5, 2), (6, 1), (7, 1), (8, 1)}
    assert codes("f.txt", "g.json", lang="xx") == {(2, 1), (4, 1), (5, 2), (6, 1), (8, 2)}
    assert codes("g.json", lang="xx", unused=True) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)} == codes("g.json")
    assert codes() == {(i, 1) for i in range(1, 9)}
    old = lists.features_of_json(spark, str(tmp_path / "g.json"), "xx")  # the tag * goes with every UPOS here too
    assert {(r.id, r.code) for r in feature_codes(sents, old, "k").collect()} == {(i, 1) for i in range(1, 7)} | {(8, 2)}
