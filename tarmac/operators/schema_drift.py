"""Schemas that drift between batches of JSON reports.

Per campaign every batch is compared with the one before it by similarity flooding: both schemas
become graphs (object paths, leaf fields, value types), start scores come from names, types and
value evidence, and scores flow along parent/child and field/type edges until they settle. The
settled scores select the correspondences between vanished and appeared fields: a pair is kept if
its score reaches what the flow must leave to any pair whose values agree (`flood` gives that bound),
so no rename is lost and most other pairs are. An exact check on the values of the runs that both
batches hold follows. Renames chain to one canonical name, by which all files are cast and united
into one table.

Value evidence needs no pairs of rows: each field gets the count and two hash sums of its
(run, type, value) triples over the runs that both batches hold, so two fields agree in every
common run exactly if these are equal. The sums are built up inside the workers that parse, so what
is shuffled are fields and not values. Only per-field figures reach a flooding task, so its size is
bounded by the number of fields of two batches.

Edge cases: bodies that are null, empty or don't parse are ignored; a body that parses to
something other than an object holds no field; rows without file id, campaign or batch
number are left out; a null run takes part in presence and types but in no comparison; repeated file ids count
once; several files of one run in a batch count by the set of their values. If several pairs pass
the exact check each is reported, since each fulfils the definition; the united table follows
one-to-one correspondences chosen by flooding score. Canonical fields beyond the united table's
column limit are kept in one map column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import jsontree
from tarmac.operators.components import least_labels
from tarmac.session import cut

TYPES = ("number", "string", "boolean", "array")
MIN_RUNS = 2
DAMP_STEPS, SETTLED = 200, 1e-3

FIELD = T.StructType([
    T.StructField("file_id", T.LongType()), T.StructField("campaign", T.StringType()), T.StructField("batch_no", T.IntegerType()), T.StructField("run", T.StringType()),
    T.StructField("field", T.StringType()), T.StructField("type", T.StringType()), T.StructField("value", T.StringType()),
])
ARROW = pa.schema([("campaign", pa.string()), ("batch_no", pa.int32()), ("old_field", pa.string()), ("new_field", pa.string()), ("score", pa.float64()), ("exact", pa.bool_()), ("chosen", pa.bool_())])
MATCH = "campaign string, batch_no int, old_field string, new_field string, score double, exact boolean, chosen boolean"


def field_values(files: DataFrame) -> DataFrame:
    """file_id, campaign, batch_no, run, field, type, value of every non-null leaf, and one row with a null field per parsed body."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for fid, c, b, r, body in pdf.itertuples(index=False, name=None):
                value = jsontree.parse(body)
                if value is jsontree.NOT_JSON:
                    continue
                out.append((fid, c, b, r, None, None, None))
                out += [(fid, c, b, r, p, jsontree.kind(v), v if isinstance(v, str) else jsontree.canonical(v)) for p, v in jsontree.leaves(value) if v is not None]
            yield pd.DataFrame(out, columns=FIELD.names)

    base = files.filter("file_id is not null and campaign is not null and batch_no is not null").dropDuplicates(["file_id"])
    return base.select("file_id", "campaign", F.col("batch_no").cast("int").alias("batch_no"), "run", "body").mapInPandas(walk, FIELD)


def runs_of(files: DataFrame) -> DataFrame:
    """campaign, batch_no, run, n_files (rows) of parsed bodies, with the batches before and after and whether these hold the run too."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [jsontree.parse(b) is not jsontree.NOT_JSON for b in pdf["body"]]
            yield pdf.loc[ok, ["campaign", "batch_no", "run"]]

    found = files.select("campaign", "batch_no", "run", "body").mapInPandas(parsed, "campaign string, batch_no int, run string")
    runs = cut(found.groupBy("campaign", "batch_no", "run").agg(F.count("*").alias("n_files")))
    w = Window.partitionBy("campaign").orderBy("batch_no")
    batches = runs.select("campaign", "batch_no").distinct()
    batches = batches.select("campaign", "batch_no", F.lag("batch_no").over(w).alias("prev_no"), F.lead("batch_no").over(w).alias("next_no"))
    wr = Window.partitionBy("campaign", "run").orderBy("batch_no")
    held = lambda f, no: F.coalesce((f("batch_no").over(wr) == F.col(no)) & F.col("run").isNotNull(), F.lit(False))
    return runs.join(batches, ["campaign", "batch_no"]).select("campaign", "batch_no", "run", "n_files", "prev_no", "next_no", held(F.lag, "prev_no").alias("in_prev"), held(F.lead, "next_no").alias("in_next"))


PART = "campaign string, batch_no int, field string, run string, triple binary, mask int, " + ", ".join(f"{k}{i} long" for k in ("back", "ahead") for i in range(3))
PRIME = (1 << 61) - 1
FLUSH = 100_000
SPREAD_FILES = 10_000  # files of one batch that share a task


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per campaign, batch and field: types as bits, and count and hash sums of the triples of runs held before or after.

    Files of a run that has several in its batch, repeated rows among them, give one row per triple
    instead, to be made distinct; so repeated rows count once without a shuffle of bodies.
    """
    sums: dict[tuple, list] = {}
    names = [c.split()[0] for c in PART.split(", ")]

    def rows(several: list) -> pd.DataFrame:
        return pd.DataFrame(several + [(c, b, f, None, None, *v) for (c, b, f), v in sums.items()], columns=names)

    for pdf in batches:
        several = []
        for c, b, run, body, n_files, in_prev, in_next in pdf.itertuples(index=False, name=None):
            value = jsontree.parse(body)
            if value is jsontree.NOT_JSON:
                continue
            for path, v in jsontree.leaves(value):
                if v is None:
                    continue
                kind = jsontree.kind(v)
                bit = 1 << TYPES.index(kind)
                back = ahead = (0, 0, 0)
                triple = b""
                if in_prev or in_next or n_files > 1:
                    triple = hashlib.blake2b(f"{run}\0{kind}\0{jsontree.canonical(v)}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    one = (1, int.from_bytes(triple[:8], "big") % PRIME, int.from_bytes(triple[8:], "big") % PRIME)
                    back, ahead = (one if in_prev else back), (one if in_next else ahead)
                if n_files > 1:
                    several.append((c, b, path, run, triple, bit, *back, *ahead))
                    continue
                s = sums.get((c, b, path))
                if s is None:
                    sums[c, b, path] = [bit, *back, *ahead]
                else:
                    s[0] |= bit
                    if in_prev:
                        s[1], s[2], s[3] = s[1] + 1, (s[2] + back[1]) % PRIME, (s[3] + back[2]) % PRIME
                    if in_next:
                        s[4], s[5], s[6] = s[4] + 1, (s[5] + ahead[1]) % PRIME, (s[6] + ahead[2]) % PRIME
        if several or len(sums) > FLUSH:
            yield rows(several)
            sums = {}
    if sums:
        yield rows([])


def transitions(files: DataFrame) -> DataFrame:
    """Per campaign, later batch and field: types before and after, evidence before and after."""
    base = files.filter("file_id is not null and campaign is not null and batch_no is not null")
    base = base.select("file_id", "campaign", F.col("batch_no").cast("int").alias("batch_no"), "run", "body")
    runs = cut(runs_of(base))
    r = runs.select(F.col("campaign").alias("c_"), F.col("batch_no").alias("b_"), F.col("run").alias("r_"), "n_files", "in_prev", "in_next")
    # Bodies of runs that parse; a body that doesn't is skipped by the worker.
    with_flags = base.join(r, (F.col("campaign") == F.col("c_")) & (F.col("batch_no") == F.col("b_")) & F.col("run").eqNullSafe(F.col("r_")))
    # Files of a batch meet, so that its fields add up inside the worker; a large batch is spread over as many tasks as it needs.
    salts = runs.groupBy("campaign", "batch_no").agg((F.sum("n_files") / SPREAD_FILES).cast("int").alias("salts"))
    with_flags = with_flags.select("campaign", "batch_no", "run", "body", "n_files", "in_prev", "in_next", F.xxhash64("file_id").alias("h")).join(salts, ["campaign", "batch_no"])
    together = with_flags.repartition("campaign", "batch_no", F.pmod("h", F.col("salts") + 1))
    part = together.select("campaign", "batch_no", "run", "body", "n_files", "in_prev", "in_next").mapInPandas(_evidence, PART)
    nums = [f"{k}{i}" for k in ("back", "ahead") for i in range(3)]
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    # Repeated triples of one run count once; sums of the others add up.
    once = part.groupBy("campaign", "batch_no", "field", "run", "triple").agg(
        F.bit_or("mask").alias("mask"), *(F.when(F.col("triple").isNotNull(), F.max(wide(c))).otherwise(F.sum(wide(c))).alias(c) for c in nums))
    per = cut(once.groupBy("campaign", "batch_no", "field").agg(F.bit_or("mask").alias("mask"), *(F.sum(c).alias(c) for c in nums)))  # read by both sides below
    batches = runs.select("campaign", "batch_no", "prev_no", "next_no").distinct()
    per = per.join(batches, ["campaign", "batch_no"])

    def side(no, evidence: str, name: str) -> DataFrame:
        n = F.col(f"{evidence}0").cast("long")
        text = F.concat_ws("/", n, *(F.pmod(f"{evidence}{i}", F.lit(PRIME)) for i in (1, 2)))
        return per.filter(F.col(no).isNotNull()).select("campaign", F.col("batch_no" if name == "new" else no).alias("batch_no"), "field", F.lit(name).alias("side"), F.struct("mask", n.alias("n"), text.alias("print")).alias("s"))

    both = side("prev_no", "back", "new").unionByName(side("next_no", "ahead", "old"))
    pick = lambda name: F.max(F.when(F.col("side") == name, F.col("s"))).alias(name)
    return both.groupBy("campaign", "batch_no", "field").agg(pick("old"), pick("new"))


@lru_cache(maxsize=100_000)
def _grams(name: str) -> tuple[str, ...]:
    plain = re.sub(r"[\W_]+", " ", name.lower()).strip()
    return tuple({f" {plain} "[i : i + 3] for i in range(len(plain))} or {plain})


def _alike(a: list[str], b: list[str]) -> np.ndarray:
    """Shared three-letter pieces of all pairs of names, as a share of both names' pieces."""
    at: dict[str, int] = {}
    rows = [[at.setdefault(g, len(at)) for g in _grams(x)] for x in (*a, *b)]
    m = np.zeros((len(rows), len(at)))
    for i, r in enumerate(rows):
        m[i, r] = 1
    size = m.sum(1)
    return (m[: len(a)] @ m[len(a) :].T) / (size[: len(a), None] + size[None, len(a) :])


def _graph(fields: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Node paths (root first), each node's parent, number of children."""
    paths, at = [""], {"": 0}
    parent = [-1]
    for f in fields:
        parts = f.split(".")
        for i in range(1, len(parts) + 1):
            p = ".".join(parts[:i])
            if p not in at:
                at[p] = len(paths)
                paths.append(p)
                parent.append(at[".".join(parts[: i - 1])] if i > 1 else 0)
    parent = np.array(parent)
    return paths, parent, np.bincount(parent[1:], minlength=len(paths)).astype(float)


AGREE = 1.0  # what equal values add to a start score


def start_scores(a: list[str], b: list[str], old: dict[str, tuple], new: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Start similarity of all node pairs, and which pairs have equal types. Equal values of two fields add AGREE."""
    last = lambda xs: [x.rpartition(".")[2] for x in xs]
    start = 0.5 * (_alike(a, b) + _alike(last(a), last(b)))
    bits = lambda xs, of, none: np.array([of[x][0] if x in of else none for x in xs])
    same_type = (bits(a, old, -1)[:, None] == bits(b, new, -2)[None, :]).astype(float)
    number: dict[str, int] = {}
    prints = lambda xs, of, none: np.array([number.setdefault(of[x][2], len(number)) if x in of and of[x][1] >= MIN_RUNS else none for x in xs])
    agree = prints(a, old, -1)[:, None] == prints(b, new, -2)[None, :]
    leaf = np.outer([x in old for x in a], [x in new for x in b])
    equal = np.array([number.setdefault("=" + x, len(number)) for x in a])[:, None] == np.array([number.setdefault("=" + x, len(number)) for x in b])[None, :]
    return start + 0.1 * same_type + AGREE * agree + 0.5 * (equal & leaf), same_type


def flood(old: dict[str, tuple], new: dict[str, tuple], steps: int = DAMP_STEPS) -> tuple[list[str], list[str], np.ndarray, float]:
    """Settled similarity of all node pairs of two schemas, and the least that a pair of equal values can have.

    old, new: field -> (type bits, evidence n, evidence print). A step adds to each pair its start score and what
    its neighbours send, and divides by the greatest sum c. A pair of equal values starts with at least AGREE / top and
    only receives, so after a step it has at least (AGREE / top + its score before) / c: the bound follows the steps.
    """
    a, pa, da = _graph(sorted(old))
    b, pb, db = _graph(sorted(new))
    start, same_type = start_scores(a, b, old, new)
    top = max(start.max(), 1e-12)
    start /= top
    seed = least = AGREE / top
    share = 1 / np.maximum(np.outer(da, db), 1)
    n_type = max(same_type.sum(), 1)
    # Members by parent, so that what members send up is summed over runs.
    ra, rb = np.argsort(pa[1:], kind="stable") + 1, np.argsort(pb[1:], kind="stable") + 1
    ga, gb = (np.flatnonzero(np.r_[True, p[r][1:] != p[r][:-1]]) if len(r) else np.empty(0, int) for p, r in ((pa, ra), (pb, rb)))
    ua, ub = pa[ra][ga], pb[rb][gb]
    above, runs, into = np.ix_(pa[1:], pb[1:]), np.ix_(ra, rb), np.ix_(ua, ub)
    now, types = start.copy(), 0.0
    for _ in range(steps):
        s = start + now
        nxt = s + same_type * (types / n_type)  # the pair of equal types feeds its fields
        if len(ra) and len(rb):
            nxt[1:, 1:] += (s * share)[above]  # a pair of objects feeds its member pairs, in equal parts
            nxt[into] += np.add.reduceat(np.add.reduceat(s[runs], ga, axis=0), gb, axis=1)  # each member pair feeds its objects
        types = (s * same_type).sum() / n_type
        c = nxt.max()
        nxt /= c
        least = (seed + least) / c
        done = np.abs(nxt - now).max() < SETTLED
        now = nxt
        if done:
            break
    return a, b, now, least


def match(old: dict[str, tuple], new: dict[str, tuple], steps: int = DAMP_STEPS) -> list[tuple[str, str, float, bool, bool]]:
    """old_field, new_field, score, exact, chosen of the pairs of a vanished and an appeared field that the settled scores select."""
    gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    if not gone or not come:
        return []
    a, b, score, least = flood(old, new, steps)
    ia, ib = {x: i for i, x in enumerate(a)}, {x: i for i, x in enumerate(b)}
    part = score[np.ix_([ia[x] for x in gone], [ib[y] for y in come])]
    pairs = [(gone[i], come[j], float(part[i, j])) for i, j in zip(*np.nonzero(part >= least * (1 - 1e-9)), strict=True)]
    pairs = [(x, y, s, old[x][1] >= MIN_RUNS and old[x][2] == new[y][2]) for x, y, s in pairs]
    pairs.sort(key=lambda p: (-p[3], -p[2], p[0], p[1]))
    left, right, out = set(), set(), []
    for x, y, s, exact in pairs:
        chosen = exact and x not in left and y not in right
        if chosen:
            left.add(x)
            right.add(y)
        out.append((x, y, s, exact, chosen))
    return out


def correspondences(changes: DataFrame) -> DataFrame:
    """Scored pairs of vanished and appeared fields; exact: they agree in every common run. A row's list holds the fields of two batches."""
    lists = changes.groupBy("campaign", "batch_no").agg(F.collect_list(F.struct("field", "old", "new")).alias("f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                side = lambda s: {x["field"]: (x[s]["mask"], x[s]["n"], x[s]["print"]) for x in r["f"] if x[s] is not None}  # noqa: B023, E731
                out += [(r["campaign"], r["batch_no"], *m) for m in match(side("old"), side("new"))]
            cols = list(zip(*out, strict=True)) if out else [()] * len(ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW, strict=True)], schema=ARROW)

    return lists.mapInArrow(run, MATCH)


def prepared(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Field changes per transition, and their correspondences."""
    changes = cut(transitions(files))
    return changes, correspondences(changes)


def found(files: DataFrame) -> DataFrame:
    """campaign, batch_no, change, old_field, new_field."""
    changes, matches = prepared(files)
    renamed = cut(matches.filter("exact").select("campaign", "batch_no", "old_field", "new_field"))
    gone = changes.filter("new is null").select("campaign", "batch_no", F.col("field").alias("old_field"))
    come = changes.filter("old is null").select("campaign", "batch_no", F.col("field").alias("new_field"))
    key = ["campaign", "batch_no"]
    row = lambda df, change, o, n: df.select(*key, F.lit(change).alias("change"), o.alias("old_field"), n.alias("new_field"))
    return (
        row(renamed, "renamed", F.col("old_field"), F.col("new_field"))
        .unionByName(row(gone.join(renamed, [*key, "old_field"], "left_anti"), "removed", F.col("old_field"), F.lit("")))
        .unionByName(row(come.join(renamed, [*key, "new_field"], "left_anti"), "added", F.lit(""), F.col("new_field")))
        .unionByName(row(changes.filter("old is not null and new is not null and old.mask <> new.mask"), "retyped", F.col("field"), F.col("field")))
    )


def canonical_names(values: DataFrame, chosen: DataFrame) -> DataFrame:
    """campaign, batch_no, field, canonical: the first name of the chain of renames that a field is in.

    Chains are components of the graph of a campaign's field names and renames, so nothing gathers a campaign.
    """
    fields = cut(values.filter("field is not null").select("campaign", "batch_no", "field").distinct())
    node = lambda f: F.to_json(F.struct("campaign", F.col(f).alias("f")))
    labels = least_labels(chosen.select(node("old_field").alias("a"), node("new_field").alias("b")))
    named = fields.groupBy("campaign", "field").agg(F.min("batch_no").alias("first")).withColumn("node", node("field")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = named.groupBy("label").agg(F.min(F.struct("first", "field")).alias("m")).select("label", F.col("m.field").alias("canonical"))
    return fields.join(named.join(firsts, "label").select("campaign", "field", "canonical"), ["campaign", "field"])


def united(files: DataFrame, max_columns: int = 2000) -> DataFrame:
    """One row per parsed file: file_id, campaign, batch_no, run and one column per canonical field.

    Columns are cast to double or boolean if all their values have that type, else they are strings.
    The max_columns fields with the most values get columns; where there are more, the others are
    held in a last column, more_fields, a map of names to texts.
    """
    _, matches = prepared(files)
    values = cut(field_values(files))
    names = canonical_names(values, matches.filter("chosen"))
    long = cut(values.filter("field is not null").join(names, ["campaign", "batch_no", "field"]).select("file_id", "canonical", "type", "value"))
    schema = long.groupBy("canonical").agg(F.array_sort(F.collect_set("type")).alias("types"), F.count("*").alias("n")).orderBy(F.desc("n"), "canonical").limit(max_columns + 1).collect()
    wide = sorted((r.canonical, r.types) for r in schema[:max_columns])
    cells = long.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "value"))).alias("m"))
    heads = values.filter("field is null").select("file_id", "campaign", "batch_no", "run")
    rows = heads.join(cells, "file_id", "left")
    out, used = [], {"file_id", "campaign", "batch_no", "run"}
    for name, types in wide:
        col = base = re.sub(r"\W+", "_", name)
        i = 1
        while col.lower() in used:
            i += 1
            col = f"{base}_{i}"
        used.add(col.lower())
        v = F.col("m")[F.lit(name)]
        as_type = {("number",): "double", ("boolean",): "boolean"}.get(tuple(types))
        out.append((v.try_cast(as_type) if as_type else v).alias(col))
    if len(schema) > max_columns:
        out.append(F.map_filter("m", lambda k, _: ~k.isin([n for n, _ in wide])).alias("more_fields"))
    return rows.select("file_id", "campaign", "batch_no", "run", *out)
