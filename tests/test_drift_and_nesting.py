"""Schema drift and nested records: brute force on small data, and the defined edge cases."""

import json

import pytest

from tarmac.functions import jsontree
from tarmac.operators import nested, schema_drift

RUNS = "file_id long, campaign string, batch_no int, run string, body string, field string, score double"


def files(spark, rows):
    return spark.createDataFrame([(i, c, b, r, body if body is None or isinstance(body, str) else json.dumps(body), "x", 1.0) for i, (c, b, r, body) in enumerate(rows)], RUNS)


def changes(spark, rows):
    return {tuple(r) for r in schema_drift.found(files(spark, rows)).collect()}


def test_renamed_added_removed_retyped(spark):
    got = changes(spark, [
        ("c", 1, "a", {"n": 1, "m": {"p": 0.5}, "k": 3, "t": 5}), ("c", 1, "b", {"n": 2, "m": {"p": 0.7}, "k": 4, "t": 6}),
        ("c", 3, "a", {"m": {"prec": 0.5}, "n": 1, "t": "5", "new": [1]}), ("c", 3, "b", {"m": {"prec": 0.7}, "n": 2.0, "t": "6", "new": [2]}),
    ])
    assert got == {("c", 3, "renamed", "m.p", "m.prec"), ("c", 3, "removed", "k", ""), ("c", 3, "added", "", "new"), ("c", 3, "retyped", "t", "t")}


def test_one_common_run_or_one_difference_is_no_rename(spark):
    one = [("c", 1, "a", {"x": 1}), ("c", 1, "b", {"x": 2}), ("c", 2, "a", {"y": 1}), ("c", 2, "z", {"y": 2})]
    assert changes(spark, one) == {("c", 2, "removed", "x", ""), ("c", 2, "added", "", "y")}
    differs = [("c", 1, "a", {"x": 1}), ("c", 1, "b", {"x": 2}), ("c", 1, "d", {"x": 3}), ("c", 2, "a", {"y": 1}), ("c", 2, "b", {"y": 2}), ("c", 2, "d", {"y": 9})]
    assert changes(spark, differs) == {("c", 2, "removed", "x", ""), ("c", 2, "added", "", "y")}
    # null against a value differs, null against null agrees
    nulls = [("c", 1, r, {"x": v, "k": 0}) for r, v in (("a", 1), ("b", 2), ("d", None))] + [("c", 2, r, {"y": v, "k": 0}) for r, v in (("a", 1), ("b", 2), ("d", None))]
    assert changes(spark, nulls) == {("c", 2, "renamed", "x", "y")}
    assert changes(spark, [(*r[:3], {"y": 7, "k": 0}) if r[1] == 2 and r[2] == "d" else r for r in nulls]) == {("c", 2, "removed", "x", ""), ("c", 2, "added", "", "y")}


def test_types_are_kept_apart(spark):
    rows = [("c", 1, "a", {"x": True}), ("c", 1, "b", {"x": 1}), ("c", 2, "a", {"y": 1}), ("c", 2, "b", {"y": True})]
    assert ("c", 2, "renamed", "x", "y") not in changes(spark, rows)


def test_edge_cases(spark):
    assert changes(spark, []) == set()
    odd = [("c", 1, "a", None), ("c", 1, "a", ""), ("c", 1, "b", "{"), ("c", 1, "d", [1, 2]), (None, 1, "a", {"x": 1}), ("c", None, "a", {"x": 1}), ("c", 2, None, {"x": 1}), ("c", 2, "e", "7")]
    assert changes(spark, odd) == {("c", 2, "added", "", "x")}
    long = "v" * 200_000
    assert changes(spark, [("c", b, r, {f: long + r}) for b, f in ((1, "x"), (2, "y")) for r in "ab"]) == {("c", 2, "renamed", "x", "y")}
    f = files(spark, [("c", 1, "a", {"x": 1}), ("c", 2, "a", {"y": 1})])
    assert schema_drift.found(f.union(f)).count() == 2


def test_runs_with_several_files_in_a_batch_count_by_their_values(spark):
    rows = [("c", 1, r, {"x": v}) for r, v in (("a", 1), ("b", 2))]
    twice = [*rows, rows[0], *(("c", 2, r, {"y": v}) for r, v in (("a", 1), ("b", 2)))]
    assert changes(spark, twice) == {("c", 2, "renamed", "x", "y")}
    assert changes(spark, [*twice, ("c", 2, "b", {"y": 3})]) == {("c", 2, "removed", "x", ""), ("c", 2, "added", "", "y")}


def test_ambiguous_pairs_are_all_reported_and_one_is_chosen(spark):
    rows = [("c", 1, r, {"score": v}) for r, v in (("a", 1), ("b", 2))] + [("c", 2, r, {"score_v2": v, "zz": v}) for r, v in (("a", 1), ("b", 2))]
    assert changes(spark, rows) == {("c", 2, "renamed", "score", "score_v2"), ("c", 2, "renamed", "score", "zz")}
    _, m = schema_drift.prepared(files(spark, rows))
    assert [r.new_field for r in m.filter("chosen").collect()] == ["score_v2"]


def test_united_table_follows_renames(spark):
    rows = [("c", 1, "a", {"n": 1, "s": "x"}), ("c", 1, "b", {"n": 2, "s": "y"}), ("c", 2, "a", {"count": 1, "s": "x"}), ("c", 2, "b", {"count": 2, "s": "y"}), ("c", 3, "b", {"total": 2, "s": 5}), ("c", 3, "a", {"total": 1, "s": 6})]
    t = schema_drift.united(files(spark, rows))
    assert {(r.batch_no, r.run, r.n, r.s) for r in t.collect()} == {(1, "a", 1.0, "x"), (1, "b", 2.0, "y"), (2, "a", 1.0, "x"), (2, "b", 2.0, "y"), (3, "a", 1.0, "6"), (3, "b", 2.0, "5")}
    few = schema_drift.united(files(spark, rows), max_columns=1)  # fields beyond the limit are kept in a map
    assert {(r.batch_no, r.run, r.n, r.more_fields["s"]) for r in few.collect()} == {(1, "a", 1.0, "x"), (1, "b", 2.0, "y"), (2, "a", 1.0, "x"), (2, "b", 2.0, "y"), (3, "a", 1.0, "6"), (3, "b", 2.0, "5")}
    assert few.columns == ["file_id", "campaign", "batch_no", "run", "n", "more_fields"]


def test_settled_scores_choose_consistent_correspondences():
    """x agrees with b.x and c.x alike; that its siblings went to c is what flooding tells, and start scores don't."""
    one, two, three = (1, 2, "h1"), (1, 2, "h2"), (1, 2, "h3")
    old = {"a.x": one, "a.y": two, "a.z": three}
    new = {"b.x": one, "c.x": one, "c.y": two, "c.z": three, "b.q": (2, 2, "h9")}
    chosen = lambda **k: {(o, n) for o, n, _, _, c in schema_drift.match(old, new, **k) if c}
    assert chosen() == {("a.x", "c.x"), ("a.y", "c.y"), ("a.z", "c.z")}
    assert ("a.x", "b.x") in chosen(steps=0)
    # every pair of equal values is selected, whatever the names, and not every pair is
    got = {(o, n) for o, n, *_ in schema_drift.match(old, new)}
    assert {("a.x", "b.x"), ("a.x", "c.x"), ("a.y", "c.y"), ("a.z", "c.z")} <= got


def test_selection_never_loses_equal_values():
    import random

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 4)))
    pruned = 0
    for _ in range(60):
        field = lambda: ".".join(word() for _ in range(rnd.randint(1, 3)))
        value = lambda: (1 << rnd.randrange(3), rnd.randint(0, 4), f"h{rnd.randrange(12)}")
        old, new = {field(): value() for _ in range(12)}, {field(): value() for _ in range(12)}
        gone, come = old.keys() - new.keys(), new.keys() - old.keys()
        got = {(o, n): e for o, n, _, e, _ in schema_drift.match(old, new)}
        want = {(o, n) for o in gone for n in come if old[o][1] >= 2 and new[n][1] >= 2 and old[o][2] == new[n][2]}
        assert want <= got.keys()
        pruned += len(gone) * len(come) - len(got)
    assert pruned > 100


def test_flooding_settles_and_prefers_names():
    old = {"a.x": (1, 0, ""), "b": (2, 0, "")}
    new = {"a.x_v2": (1, 0, ""), "c": (2, 0, "")}
    a, b, s, _ = schema_drift.flood(old, new)
    assert s[a.index("a.x"), b.index("a.x_v2")] > s[a.index("a.x"), b.index("c")]


def brute(value):
    out = []

    def walk(v, path, holder):
        if isinstance(v, dict):
            if path:
                out.append((path, holder))
            for k, x in v.items():
                walk(x, path + "/" + k.replace("~", "~0").replace("/", "~1"), path)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}/{i}", holder)

    walk(value, "", "")
    return out


DOCS = "report_id long, body string, path string, fields string"


def test_objects_of_nested_bodies(spark):
    bodies = [
        {"a": {"b~/c": {}, "l": [[{"x": 1}, {"y": [{"z": 2}]}], []]}, "n": None}, {}, [{"q": {"w": 1}}, [[{"e": 1}]]], 5, {"one": {"k": 1}, "many": [{"k": 1}, {"k": 2}]},
    ]
    rows = [(i, json.dumps(b), "p", "f") for i, b in enumerate(bodies)] + [(90, '{"a": {"v": NaN}}', "p", "f"), (91, None, "p", "f"), (92, "", "p", "f"), (93, "  ", "p", "f"), (94, '{"a": {', "p", "f"), (None, '{"a": {}}', "p", "f")]
    got = {tuple(r) for r in nested.found(spark.createDataFrame(rows + rows[:2], DOCS)).collect()}
    want = {(i, p, h) for i, b in enumerate(bodies) for p, h in brute(b)} | {(90, "/a", "")}
    assert got == want
    assert nested.found(spark.createDataFrame([], DOCS)).count() == 0


def test_very_deep_and_long_bodies(spark):
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    rows = [(1, deep, "", ""), (2, json.dumps({f"k{i}": {"v": "x" * 100} for i in range(5000)}), "", "")]
    got = nested.found(spark.createDataFrame(rows, DOCS)).groupBy("report_id").count().collect()
    assert {tuple(r) for r in got} == {(1, 2999), (2, 5000)}
    assert jsontree._parse_deep('{"a": [1, {"b": []}, "x"], "c": {}}') == {"a": [1, {"b": []}, "x"], "c": {}}
    assert all(jsontree._parse_deep(x) is jsontree.NOT_JSON for x in ("{", "[1,]", '{"a" 1}', "[1] 2", '{"a": 1,}', ""))


def test_flat_tables_link_to_their_parents(spark):
    rows = [(1, json.dumps({"groups": [{"keep": "a", "members": [{"id": 1}, {"id": 2}]}, {"keep": "b"}]}), "", ""), (2, json.dumps({"groups": {"keep": "c", "n": 1}}), "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    merged = nested.merged_schema(docs, "report_id", "body")
    schema = {(r.table, r.column): (list(r.kinds), r.optional, r.parent_table) for r in merged.collect()}
    assert schema["/groups", "keep"] == (["string"], False, "") and schema["/groups", "n"][:2] == (["number"], True) and schema["/groups/members", "id"][::2] == (["number"], "/groups")
    recs = nested.records(docs, "report_id", "body", merged)
    g, m = nested.flat_table(recs, merged, "/groups").collect(), nested.flat_table(recs, merged, "/groups/members").collect()
    keep = {r.record_key: r.keep for r in g}
    assert [keep[r.parent_key] for r in m] == ["a", "a"] and {tuple(r.ordinal) for r in m} == {(0,), (1,)}
    assert {(r.keep, tuple(r.ordinal), r.n) for r in g} == {("a", (0,), None), ("b", (1,), None), ("c", (), 1.0)}


def test_many_columns_and_keys_that_are_data(spark, monkeypatch):
    rows = [(1, json.dumps({"per": {f"k{i}": {"v": i, f"c{i}": i} for i in range(1200)}, "plain": [[1, 2], [3]], "mixed": [1, {"x": 2}, [{"y": 3}, 4]]}), "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    merged = nested.merged_schema(docs, "report_id", "body")
    got = nested.flat_table(nested.records(docs, "report_id", "body", merged), merged, "/per/*").collect()
    assert len(got) == 1200 and all(r.v == int(r.member[1:]) for r in got)
    assert sum(f"c{r.member[1:]}" in r.more_fields for r in got) == 201 and len(got[0]) == 1006  # 1201 columns, 1000 of them wide
    plain = lambda: {(r.table, r.path): (r.fields, tuple(r.ordinal)) for r in nested.records(docs, "report_id", "body").collect()}
    one = plain()
    assert one["", ""][0] == {"plain": "[[1,2],[3]]", "mixed": "[1,4]"} and one["/mixed", "/mixed/2/0"] == ({"y": "3"}, (2, 0))
    monkeypatch.setattr(nested, "MAX_TABLES", 3)
    assert plain() == one
