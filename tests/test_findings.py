"""Growth and ties: what larger tables showed."""

from __future__ import annotations

import math
import re
from hashlib import md5
from itertools import accumulate

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from deviatix.functions import special
from deviatix.functions import text as T
from deviatix.operators import descriptors as D
from deviatix.operators import learning as L
from deviatix.operators import parametric as P
from deviatix.operators import signal as G
from deviatix.operators import stats as ST
from deviatix.plans.library import ORACLES, QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_pair_of_channels_is_read_once(spark):
    wave = [float((7 * k) % 23) for k in range(400)]
    rows = [("r", "a", wave), ("r", "b", [-2 * x for x in wave]), ("r", "c", [x * x % 17 for x in wave])]
    d = D.duplicate_channels(spark.createDataFrame(rows, "rec string, ch string, x array<double>"), "rec", "ch", "x", F.lit(False), rate=10.0)
    assert [tuple(r) for r in d.collect()] == [("r", "b", "a")]
    assert plan(d).count("zip_with(") == 1  # 145 when a step of the sums evaluated the pair again


def test_pair_of_no_asymmetry_or_of_equal_ones(spark):
    p = {("alone", 0): 3.0, ("alone", 1): 4.0, ("even", 0): 1.0, ("even", 1): 1.0, ("even", 2): 3.0, ("even", 3): 3.0}
    s = spark.createDataFrame([(seg, c, 1.0, v) for (seg, c), v in p.items()], "seg string, channel int, f double, p double")
    got = {r.seg: (r.q_asym, r.pair) for r in G.pair_asymmetry(s, ["seg"], "channel", [(0, 2), (1, 3)]).collect()}
    assert got["alone"] == (None, None) and got["even"][1] == 1
    assert "arg_max" not in ORACLES["dsp11_pair_asymmetry"]  # which leaves ties to chance


def both(spark, folder, name, **tables):
    """The query's rows and its SQL's, on small tables."""
    c = duckdb.connect()
    for k, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{k}.parquet")
        c.sql(f"CREATE VIEW {k} AS SELECT * FROM '{folder}/{k}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    rows = lambda x: sorted(map(tuple, x), key=str)
    return rows(got.select(*columns).collect()), rows(c.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())


def tied_events(spark):
    """A user's greatest value stands at two stages, in either order."""
    rows = [(1, "click", 300.0), (1, "view", 300.0), (1, "purchase", 10.0), (2, "view", 300.0), (2, "click", 300.0), (2, "signup", 10.0)]
    return spark.createDataFrame(rows, "user_id long, event_type string, value double")


def test_report_of_equal_peaks(spark, tmp_path):
    got, want = both(spark, tmp_path, "tx17_structured_report", events=tied_events(spark))
    assert got == want and [r[0].startswith("focus: left view, theta") for r in got] == [True, True]


def test_paragraph_of_equal_peaks(spark, tmp_path):
    got, want = both(spark, tmp_path, "tx16_paragraph", events=tied_events(spark))
    assert got == want and ["States: view." in r[0] for r in got] == [True, True]


def test_paragraph_of_unknown_values_stages_and_users(spark, tmp_path):
    rows = [(1, "click", None), (1, "view", None), (2, "click", -2.0), (2, "view", -1.0), (3, None, 400.0), (3, "view", 300.0), (3, "click", 10.0), (4, None, 400.0), (None, "view", 300.0), (None, "click", 20.0), (5, "", 70.0)]
    rows += [(6, "view", 251.0)] + [(6, "click", 20.0)] * 9
    got, want = both(spark, tmp_path, "tx16_paragraph", events=spark.createDataFrame(rows, "user_id long, event_type string, value double"))
    text = {user: p for p, user in got}
    assert got == want and set(text) == {None, 1, 2, 3, 4, 5, 6}
    assert text[1] == "" and ": 0.0 SD." in text[2] and "(top region view)" in text[3] and "top region" not in text[4] and "States" not in text[5]


def test_argmax_of_equal_deviations(spark, tmp_path):
    rows = [(1, 1, 1.0, 45000.0, 0.05, 0.02, "N"), (1, 2, 1.0, 45000.0, 0.05, 0.02, "N"), (2, 2, 1.0, 45000.0, 0.05, 0.02, "N"), (2, 1, 1.0, 45000.0, 0.05, 0.02, "N")]
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string")
    got, want = both(spark, tmp_path, "w19_argmax", lineitem=li)
    assert got == want and [r[0] for r in got] == [2, 2]


def test_rest_of_a_long_text(spark):
    own = [f"Line {k % 700}, Text {'x' * (k % 5)}" for k in range(1500)] + [" ", "LINE-3 text xxx ", "new"]
    other = [f"line {k} text {'x' * (k % 5)}" for k in range(0, 700, 3)] + ["", "twice", "twice"]
    key = lambda s: re.sub("[^a-z0-9]", "", s.lower())[:60]
    theirs = {key(s) for s in other if s}
    want = ". ".join(s.strip() for s in own if s.strip() and key(s) not in theirs)
    rows = [(".".join(own), ".".join(other), want), ("a; B.a", "", "a. B. a"), ("a; b", None, "a. b"), (None, "a", ""), ("a.b", "A\nb", ""), ("?. a", "!", "a")]
    d = spark.createDataFrame(rows, "a string, b string, want string").select("want", T.not_repeated(F.col("a"), F.col("b")).alias("got"))
    assert all(r.got == r.want for r in d.collect())
    assert "array_contains" not in plan(d)  # each sentence against each of the other text's


def test_medians_of_replicates(spark):
    rows = [(u, float((u * 37 + k * k) % 101)) for u in range(40) for k in range(u % 4 + 1)] + [(50, None)]
    df = spark.createDataFrame(rows, "u long, v double")
    weight = lambda r, u: sum(int(md5(f"0|{r}|{u}".encode()).hexdigest()[:8], 16) / 4294967296.0 >= s for s in accumulate(1 / (math.e * math.factorial(k)) for k in range(7)))
    want = {}
    for r in range(12):
        values = sorted(v for u, v in rows if v is not None for _ in range(weight(r, u)))
        want[r] = values[(len(values) + 1) // 2 - 1]
    got = ST.bootstrap_median(df, "v", "u", 12)
    assert {r.replicate: r.median for r in got.collect()} == want
    none = [r for r in range(12) if not weight(r, 7)]
    assert none and {r.replicate for r in ST.bootstrap_median(df.where("u = 7"), "v", "u", 12).collect()} == set(range(12)) - set(none)
    assert "Generate explode(" not in plan(got)  # a row for each replicate


def test_table_one_holds_no_stratum(spark, tmp_path):
    o = spark.createDataFrame([(k, "F" if k % 3 else "O", 1000.0 * k * (k % 7), "1-URGENT" if k % 4 else "5-LOW") for k in range(300)], "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    got, want = both(spark, tmp_path, "a16_table_one", orders=o)
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]
    assert "percentile(o_totalprice" not in plan(QUERIES["a16_table_one"](spark, str(tmp_path)))  # an aggregate that holds all prices


def test_fit_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(x):
        seen.add(1)
        return x

    rows = [(b, u, float((b * 7 + u * 3) % 11) + (b % 2) * (u == 1), b % 2) for b in range(12) for u in range(4)]
    df = spark.createDataFrame(rows, "bag long, unit long, x double, y int").withColumn("x", F.udf(noted, "double")("x"))
    model = L.multiple_instance(df, ["x"], "bag", "unit", "y", k=2, rounds=2)
    assert seen.value == len(rows)
    assert L.scored(model, df).count() == len(rows)


def test_sides_beside_accents(spark, tmp_path):
    texts = ["tion éthe", "tion theé", "tion of́", "tion İn", "tion ofß", "TİON the", "tion wàs wasà", "tion ın iǹ", "x tion ́the", "tion éthe", "tion in, of_ tion", "in tion\nthe tion of", "the tion. tion of", None]
    got, want = both(spark, tmp_path, "tx01_tx04_side_band", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got == want


def test_curve_searches_each_cell_once(spark, monkeypatch):
    """Only the cells without a fit are searched for a robust curve, and the fits are not one task's."""
    r, given, tasks, put = np.random.default_rng(3), [], [], P.stored
    good, steps = np.exp(r.normal(2, 0.2, 900)), np.where(np.arange(900) % 9 < 8, 2.0, -1.0)
    df = spark.createDataFrame([(k, float(i % 3), float(v)) for k, values in (("good", good), ("steps", steps)) for i, v in enumerate(values)], "cell string, age double, v double")

    def noted(rows, *a, of=P.robust_curve, **b):
        given.extend(x.cell for x in rows.select("cell").distinct().collect())
        return of(rows, *a, **b)

    def written(rows, tag):
        if "MapInPandas" in plan(rows) and rows.count():
            tasks.append(rows.rdd.getNumPartitions())
        return put(rows, tag)

    monkeypatch.setattr(P, "robust_curve", noted)
    monkeypatch.setattr(P, "stored", written)
    curve = P.bct_curve(df, ["cell"], "age", "v", [0.0, 1.0, 2.0], 0.3, ranks=19)
    assert {x.cell for x in curve.select("cell").where("fam = 'NO'").collect()} <= {"steps"} == set(given)
    assert max(tasks) > 1


def test_ends_of_a_curve_are_found_once(monkeypatch):
    n, asked = 4000, []
    y, nu = np.exp(np.random.default_rng(4).normal(0, 1, n)), np.where(np.arange(n) % 2, 0.4, -0.3)
    y[5] = np.nan

    def noted(t, df, of=special.t_cdf_np):
        asked.append(np.size(t))
        return of(t, df)

    monkeypatch.setattr(special, "t_cdf_np", noted)
    z = special.bct_z_np(y, np.full(n, 1.0), np.full(n, 0.5), nu, np.full(n, 6.0))
    assert sum(asked) <= n + 2  # an end for each row and side before
    monkeypatch.undo()
    alone = [special.bct_z_np(*[np.array([v]) for v in (y[i], 1.0, 0.5, nu[i], 6.0)])[0] for i in range(0, n, 97)]
    assert z[::97] == pytest.approx(alone, abs=1e-9) and np.isnan(z[5]) and np.isnan(z).sum() == 1


def test_nan_keeps_no_fraction_going():
    steps = []

    class Noted(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, **kw):
            steps.append(1)
            out = getattr(ufunc, method)(*[np.asarray(v) if isinstance(v, Noted) else v for v in inputs], **kw)
            return out.view(Noted) if isinstance(out, np.ndarray) else out

    for x in ([0.2, 0.3], [0.2, np.nan]):
        steps.append(0)
        special._beta_fraction(np.full(2, 3.0), np.full(2, 0.5), np.array(x).view(Noted))
    first = steps.index(0, 1)
    assert len(steps) - first <= 2 * first  # 299 steps before
