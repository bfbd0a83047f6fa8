"""Operators against independent Python on small rows, properties, error paths and round trips."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import color, text
from plumbline.functions import taxonomy as tax
from plumbline.operators import bench, figures, judge, manifest, pixels, qa, route, scoring, split, synth
from plumbline.plans import registry
from plumbline.sources import files, records, regions, sinks
from plumbline.streaming import runs as streams


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def raw(spark):
    rng = random.Random(0)
    rows = []
    for i in range(30):
        true = tax.LABELS[i % 11]
        for c in range(4 if i else 3):
            pred = None if rng.random() < 0.1 else true if i % 5 else rng.choice(tax.LABELS) if i % 10 else "photo"
            rows.append((f"{true}/{i}.png", true if i % 3 else ("" if i % 2 else None), pred, None if pred is None else rng.choice([0.0, 0.1, 0.35, 1.0, 0.77]), c, 0.01, None))
    rows.append(("zebra/9.png", "zebra", "zebra", 0.9, None, None, None))
    return spark.createDataFrame(rows, records.RUN), rows


def test_judge_blocks_against_python(raw):
    df, rows = raw
    runs = judge.tidy(df).cache()
    calls = [(f, t or f.split("/")[0], p, c) for f, t, p, c, *_ in rows]
    tidy = [(f, t if t in tax.LABELS else None, p if p in tax.LABELS else None, c, p is not None and p == t) for f, t, p, c in calls]
    o = one(judge.overall(runs))
    assert o["n_calls"] == len(tidy) and o["micro_accuracy"] == round(sum(x[4] for x in tidy) / len(tidy), 6)
    by = {}
    for _, t, _, _, ok in tidy:
        if t:
            by.setdefault(t, []).append(ok)
    assert o["macro_accuracy"] == round(sum(sum(v) / len(v) for v in by.values()) / len(by), 6)
    n = runs.filter("true IS NOT NULL AND pred IS NOT NULL").count()
    assert judge.confusion_counts(runs).agg(F.sum("n")).first()[0] == n
    got = {r["label"]: r for r in judge.per_class(runs).collect()}
    assert list(sorted(got)) == sorted(tax.LABELS)
    for lab in tax.LABELS:
        tp = sum(t == lab == p for _, t, p, _, _ in tidy)
        pr, su = sum(p == lab for _, _, p, _, _ in tidy), sum(t == lab for _, t, *_ in tidy)
        assert got[lab]["f1"] == round(2 * tp / (pr + su), 6) if pr + su else got[lab]["f1"] == 0
    usable = [(c, ok) for _, _, p, c, ok in tidy if p and c is not None]
    gaps, total = [], 0.0
    for b in range(10):
        m = [(c, ok) for c, ok in usable if (c > b / 10 or b == 0) and c <= (b + 1) / 10 + 1e-12]
        if m:
            gap = abs(sum(ok for _, ok in m) / len(m) - sum(c for c, _ in m) / len(m))
            gaps.append(gap)
            total += len(m) / len(usable) * gap
    e = one(judge.ece_mce(runs))
    assert e == {"ece": round(total, 6), "mce": round(max(gaps), 6)} and e["ece"] <= e["mce"] <= 1
    clip = lambda x: min(max(x, 1e-12), 1 - 1e-12)
    ll = [-math.log((clip(c) if ok else clip((1 - c) / 12)) / (clip(c) + 12 * clip((1 - c) / 12))) for c, ok in usable]
    assert abs(one(judge.losses(runs))["confidence_logloss"] - sum(ll) / len(ll)) < 1e-5
    pf = judge.per_file(runs).collect()
    for r in pf:
        v = Counter(p or tax.NONE for f, _, p, _, _ in tidy if f == r["file"])
        h = -sum(k / sum(v.values()) * math.log2(k / sum(v.values())) for k in v.values())
        assert abs(r["entropy_bits"] - h) < 1e-9 and r["distinct_labels"] == len(v)
        assert abs(r["agreement"] - max(v.values()) / sum(v.values())) < 1e-12
        assert (r["agreement"] == 1) == (abs(r["entropy_bits"]) < 1e-12)
    warned = {r["warning"]: r["n"] for r in judge.validate(df).collect()}
    assert warned["true labels outside taxonomy"] == 1 and "uneven repeat counts" in warned
    lo, hi, reps = judge.bootstrap(runs, reps=200).first()
    assert lo <= o["micro_accuracy"] <= hi and reps == 200
    idx = [r["idx"] for r in judge.dense_index(runs.select("file").distinct()).collect()]
    assert sorted(idx) == list(range(len(idx)))
    assert set(judge.report(df, ["overall", "nothing"])) == {"overall"}


def test_bootstrap_draws_are_the_same_at_every_size(spark):
    calls = [(f"{k}/{i}.png", k, k if (i * 7 + c) % 5 else "map", 0.5, c, 0.0, None) for i in range(40) for k in ("bar", "line") for c in range(1 + i % 3)]
    runs = judge.tidy(spark.createDataFrame(calls, records.RUN))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for macro in (False, True):
        few = judge.bootstrap(runs, macro, reps=100).first()
        try:  # as at a size where the statistics are no broadcast any more
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            many = judge.bootstrap(runs, macro, reps=100).first()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        assert few == many and few["reps"] == 100


def test_empty_runs(spark):
    runs = judge.tidy(spark.createDataFrame([], records.RUN))
    assert judge.overall(runs).first()["n_calls"] == 0
    assert judge.per_class(runs).count() == 13 and judge.reliability_table(runs).count() == 10
    assert judge.bootstrap(runs).first()["lo"] is None and judge.ece_mce(runs).first()["ece"] is None
    assert judge.losses(runs).first()["brier_top_label"] is None and judge.consistency(runs).count() == 1


def test_splits(spark):
    rng = random.Random(1)
    rows = [(f"d{d}__p001__{i}.png", rng.choice(tax.LABELS[:4]), f"d{d}", "real", "train") for d in range(9) for i in range(rng.randint(1, 30))]
    index = spark.createDataFrame(rows, "path string, label string, doc string, source string, split string")
    kept = split.cap_round_robin(index, 7).collect()
    n = Counter(r["label"] for r in kept)
    assert all(v == min(7, sum(x[1] == k for x in rows)) for k, v in n.items())
    for lab in n:  # no document gives two more than another that still has some
        per = Counter(r["doc"] for r in kept if r["label"] == lab)
        for d, total in Counter(x[2] for x in rows if x[1] == lab).items():
            assert per[d] == total or per[d] >= max(per.values()) - 1
    assert split.cap_round_robin(index, 0).count() == len(rows)
    a = split.assign_docs(index)
    assert set(a.values()) == {"train", "val"} and len(a) == 9
    more = index.unionByName(spark.createDataFrame([("e__1.png", "map", "e", "real", "train")] * 3, index.schema))
    b = split.assign_docs(more, existing=a)
    assert {d: b[d] for d in a} == a and "e" in b
    w = {r["label"]: r["weight"] for r in split.class_weights(index).collect()}
    c = Counter(x[1] for x in rows)
    total = sum(max(c[x], 1) for x in tax.LABELS)
    assert all(abs(w[x] - total / (13 * max(c[x], 1))) < 1e-5 for x in tax.LABELS)
    gaps = {(r["label"], r["warning"]) for r in split.gap_warnings(index).collect()}
    assert ("photo", "no real images") in gaps and ("bar", "absent from val") in gaps and ("bar", "no synthetic images") in gaps and not any(lab is None for lab, _ in gaps)
    leaky = index.unionByName(index.filter("doc IN ('d1', 'd2')").withColumn("split", F.lit("test")))
    assert (None, "2 documents in train or val and in test") in {(r["label"], r["warning"]) for r in split.gap_warnings(leaky).collect()}


def test_checkpoint_fold(spark):
    h = [(1, 1, 0.5, 1.0), (1, 2, 0.5 + 5e-7, 0.9), (1, 3, float("nan"), 0.1), (1, 4, 0.6, 2.0), (1, 5, 0.5, 0.1), (1, 6, 0.5, 0.1), (1, 7, 0.9, 0.1)]
    df = spark.createDataFrame(h, "run int, epoch long, val_macro_f1 double, val_loss double")
    assert tuple(split.best_checkpoint(df, patience=2).first()) == (1, 4, 6)
    assert tuple(split.best_checkpoint(df.filter("epoch < 4")).first())[1] == 2


def test_manifest_and_commit(spark, tmp_path):
    path = str(tmp_path / "m.jsonl")
    lines = ['{"filename": "a.png", "page": 1, "x": {"deep": [1]}}', "", "no json", '{"filename": "b.png"}', '{"page": 3}', '{"filename": "a.png", "page": 2, "manual_root": "bar"}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines) + "\n")
    m = {r["filename"]: r["page"] for r in records.read_manifest(spark, path).collect()}
    assert m == {"a.png": 2, "b.png": None}
    moves = spark.createDataFrame([(1, "a.png", "in", "bar"), (2, "a.png", "bar", "line"), (3, "a.png", "bar", "map"), (4, "b.png", "in", "in"), (5, "b.png", "in", "../up"), (6, "c.png", "in", "bar"), (7, "b.png", "in", "bar"), (8, "b.png", "bar", "taken"), (9, None, "x", "y")], "ord long, file string, `from` string, `to` string")
    here = spark.createDataFrame([("a.png", "in"), ("b.png", "in"), ("b.png", "taken")], "file string, folder string")
    rep = {r["ord"]: (r["moved"], r["reason"]) for r in manifest.commit_moves(moves, here).collect()}
    assert rep == {1: (True, None), 2: (True, None), 3: (False, "source file missing"), 5: (False, "path escapes root"), 6: (False, "source file missing"), 7: (True, None), 8: (False, "already exists in taken")}
    out = manifest.patch_manifest(records.read_lines(spark, path), manifest.commit_moves(moves, here)).orderBy("ord").collect()
    for before, r in zip(lines, out, strict=True):
        if r["touched"]:
            want = json.loads(before) | {"manual_root": "line" if "a.png" in before else "bar"}
            assert json.loads(r["value"]) == want
        else:
            assert r["value"] == before
    patched = spark.createDataFrame([(i, r["value"]) for i, r in enumerate(out)], "ord long, value string")
    sinks.rewrite_lines(patched, str(tmp_path / "out"))
    assert [r["value"] for r in records.read_lines(spark, str(tmp_path / "out")).orderBy("ord").collect()] == [r["value"] for r in out]


def test_routing_rules(spark):
    d = spark.createDataFrame([(100, 500, 0, 255), (150, 150, 0, 255), (2000, 130, 0, 255), (400, 300, 10, 21), (400, 300, 10, 22)], "w int, h int, lo int, hi int")
    got = [r[0] for r in d.select(route.junk_reason(*map(F.col, ("w", "h", "lo", "hi")))).collect()]
    assert got == ["too_small_100x500", "area_too_small_22500", "extreme_aspect_15.4", "near_uniform", None]
    c = spark.createDataFrame([("picture", "bar_chart", 0.75, None, None), ("picture", "bar_chart", 0.74, "map", 0.75), ("picture", "icon", 0.9, "map", 0.76), ("table", "other", 0.1, "map", 0.99), ("picture", "other", 0.99, None, None), ("picture", "unheard", 0.9, None, None)], "kind string, raw_label string, raw_confidence double, llm_label string, llm_confidence double")
    got = [(r["mapped_label"], r["routed_to"], r["decision_layer"]) for r in route.decide(c).collect()]
    assert got == [("bar", "bar", "docling"), ("bar", "_review", "manual"), ("other", "map", "llm"), ("table", "table", "docling"), ("other", "_review", "manual"), ("other", "other", "docling")]


def test_replies(spark):
    cases = ['{"label": "bar", "confidence": 1}', 'x {"label": "a", "confidence": 0.5} y', "```json\n{\"label\": \"a\",\n\"confidence\": 0.25}\n```", '{"label": "a", "confidence": "0.5"}', '{"label": "a", "confidence": true}', '{"label": " ", "confidence": 0.1}', '{"label": "a", "confidence": 1.2}', "[1]", "{broken", "", None, '{"label": 3, "confidence": 0.1}']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, content string")
    got = [(r["label"], r["confidence"], (r["error"] or "")[:7]) for r in route.validate_reply(df).orderBy("i").collect()]
    assert got[:3] == [("bar", 1.0, ""), ("a", 0.5, ""), ("a", 0.25, "")]
    assert [g[2] for g in got[3:]] == ["respons"] * 5 + ["invalid", "no mess", "no mess", "respons"]


def test_allocation_and_seeds(spark):
    import hashlib

    counts = spark.createDataFrame([(k, n) for k, n in zip(synth.SUBTYPES, (0, 1, 7, 10, 13, 99, 200, 3, 11, 50, 17, 33), strict=True)], "label string, n long")
    dim = synth.subtype_dimension(spark)
    got = {}
    for r in synth.allocate(counts, dim).collect():
        got.setdefault(r["label"], {})[r["sub_type"]] = r["n"]
    for r in counts.collect():
        w, n = synth.SUBTYPES[r["label"]], r["n"]
        exact = [n * v / sum(w.values()) for v in w.values()]
        low = [int(e) for e in exact]
        for i in sorted(range(len(low)), key=lambda i: (-round(exact[i] - low[i], 9), i))[: n - sum(low)]:
            low[i] += 1
        assert got[r["label"]] == dict(zip(w, low, strict=True)) and sum(low) == n
    t = synth.task_plan(counts, dim, 7).first()
    assert t["seed"] == int.from_bytes(hashlib.sha1(f"7|{t['label']}|{t['sub_type']}|{t['i']}".encode()).digest()[:4], "big")
    label, sub, seed = (spark.createDataFrame([("a__b__c__12",)], "c string").select(*synth.parse_crop_id(F.col("c"))).first())
    assert (label, sub, seed) == ("a__b", "c", 12)


def test_unknown_label_is_an_error(spark):
    from pyspark.errors import PySparkException

    row = {"label": "zebra"} | figures.structure("photo", "", {"series": [], "n": 0})
    df = spark.createDataFrame([row], f"label string, {figures.STRUCTURE}")
    with pytest.raises(PySparkException):
        df.select(synth.violation(F.col("label"))).collect()


def test_waterfall_and_stacks(spark):
    rows = [(1, "start", 10.0), (2, "delta", -4.0), (3, "delta", 6.0), (4, "subtotal", 0.0), (5, "delta", -20.0), (6, "end", 0.0)]
    df = spark.createDataFrame([(0, *r) for r in rows], "chart int, pos int, kind string, value double")
    got = [(r["bottom"], r["height"], r["level"]) for r in synth.waterfall(df, "chart", ["pos"]).orderBy("pos").collect()]
    assert got == [(0, 10, 10), (6, 4, 6), (6, 6, 12), (0, 12, 12), (-8, 20, -8), (0, -8, -8)]
    base = [r["base"] for r in synth.stack_base(df, ["chart"], ["pos"]).orderBy("pos").collect()]
    assert base == [0, 10, 6, 12, 12, -8]


def test_floor_quantiles(spark):
    rng = random.Random(2)
    data = [("a", rng.randint(0, 50)) for _ in range(101)] + [("b", 3)]
    got = {r["g"]: r for r in qa.floor_quantiles(spark.createDataFrame(data, "g string, v int"), "g", "v").collect()}
    for g in "ab":
        v = sorted(x for k, x in data if k == g)
        assert [got[g][f"p{p:02d}"] for p in (5, 25, 50, 75, 95)] == [v[int(p / 100 * (len(v) - 1))] for p in (5, 25, 50, 75, 95)]


def test_numbers_and_colors(spark):
    d = spark.createDataFrame([(2.675,), (0.5,), (1234567.891,), (-3.005,)], "v double")
    assert [r[0] for r in d.select(text.python_round(F.col("v"), 2)).collect()] == [round(x, 2) for x in (2.675, 0.5, 1234567.891, -3.005)]
    assert d.select(text.format_number(F.col("v"), 1, "de")).collect()[2][0] == "1.234.567,9"
    assert spark.range(1).select(text.parse_number(F.lit("1.234,5"), "de"), text.parse_number(F.lit("x"), "de")).first()[:] == (1234.5, 0.0)
    r = spark.range(1).select(color.mix(F.lit("#000000"), F.lit("#ffffff"), F.lit(0.5)).alias("m"), color.readable_on(F.lit("#000000")).alias("r"), color.luminance(color.contrast_on(F.lit("#fafafa"), F.lit("#ffffff"))).alias("c"), color.luminance(color.min_luminance(F.lit("#000000"), 0.42)).alias("l"), color.ramp(F.array(F.lit("#000000"), F.lit("#808080"), F.lit("#ffffff")), 5).alias("p")).first()
    assert r["m"] == "#808080" and r["r"] == "#f2f4f7" and r["c"] <= 0.75 and r["l"] >= 0.42 and len(set(r["p"])) == 5 and r["p"][0] == "#000000" and r["p"][-1] == "#ffffff"
    tri = spark.range(1).select(color.polygon_area(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (3, 0), (0, 4))]))).first()[0]
    assert tri == 6.0


def test_bench_metrics(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(13), 80)
    y = rng.integers(0, 10, 80)
    df = spark.createDataFrame([(i, [float(x) for x in q], int(t)) for i, (q, t) in enumerate(zip(p, y, strict=True))], "id int, probs array<double>, target int")
    assert abs(bench.nll_accuracy(df).first()["nll"] + np.log(p[np.arange(80), y]).mean()) < 1e-5
    names, ids = bench.merge_map([["bar", "line"]])
    assert len(names) == 12 and ids[4] == ids[0]
    q = np.zeros((80, 12))
    for old, new in ids.items():
        q[:, new] += p[:, old]
    yy = np.array([ids[t] for t in y])
    assert abs(bench.merged(df, [["bar", "line"]]).first()["nll"] + np.log(q[np.arange(80), yy]).mean()) < 1e-5
    for bad in ([["zebra", "bar"]], [["bar", "line"], ["line", "map"]]):
        with pytest.raises(ValueError):
            bench.merge_map(bad)
    t = spark.createDataFrame([(1, "map"), (2, "bar")], "id int, label string")
    with pytest.raises(ValueError):
        bench.remap(t, ["bar", "line"])
    with pytest.raises(ValueError):
        scoring.check_labels(list(tax.LABELS[:12]))
    scoring.check_labels(list(tax.LABELS))


def test_head_training_lowers_the_loss(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 1, (13, 64))
    rows = [(i, [float(v) for v in centre[i % 13] + rng.normal(0, 0.3, 64)], i % 13) for i in range(260)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>, target int")
    head, history = scoring.train_head(df, epochs=8)
    assert history[-1]["train_loss"] < history[0]["train_loss"] and history[-1]["train_acc"] > 0.9
    got = scoring.predict(df, head).collect()
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 for r in got) and len(got) == 260


def test_judge_client_seam(spark):
    plan = judge.call_plan(spark.createDataFrame([("bar/1.png",), ("map/2.png",)], "file string"), 3)
    assert plan.count() == 6
    out = scoring.score_replies(plan, lambda f: (None, 0.5, "down") if f.startswith("map") else ('{"label": "bar", "confidence": 0.5}', 0.25, None), pause=0).collect()
    assert {(r["file"][:3], r["cost"], r["error"]) for r in out} == {("bar", 0.25, None), ("map", 1.5, "down")}


def test_samples_are_valid_and_repeat(spark):
    tasks = spark.createDataFrame([(k, s, 11 + i) for i, (k, subs) in enumerate(synth.SUBTYPES.items()) for s in subs], "label string, sub_type string, seed long")
    tried = figures.attempts(tasks)
    assert tried.filter("attempt = 0 AND violation IS NOT NULL").count() < tried.filter("attempt = 0").count() / 5
    few = tasks.filter("sub_type IN ('plain', 'pie', 'single', 'org_chart', 'outline', 'comparison', 'logo')")
    sizes = ((160, 200), (240, 150))
    a, b = (sorted((r["crop_id"], bytes(r["image"] or b""), r["error"]) for r in figures.samples(few, sizes).collect()) for _ in range(2))
    assert a == b and all(e is None for _, _, e in a)
    img = figures.decode_png(a[0][1])
    assert img.ndim == 3 and figures.decode_png(figures.png(img)).tolist() == img.tolist()
    sheet = figures.decode_png(figures.contact_sheet([x[1] for x in a]))
    assert sheet.shape[1] == 8 * 96
    x = scoring.preprocess(img)
    assert x.shape == (3, 224, 224)
    jittered = [scoring.preprocess(img, rng=np.random.default_rng(k)) for k in (0, 0, 1)]
    assert np.array_equal(jittered[0], jittered[1]) and not np.array_equal(jittered[0], jittered[2]) and 0 < np.abs(jittered[0] - x).mean() < 0.6
    first = {r["crop_id"]: bytes(r["image"]) for r in figures.samples(few, sizes).collect()}
    assert figures.regenerate(a[0][0], sizes)["image"] == first[a[0][0]]
    for bad in ("bar__plain", "zebra__plain__1", "bar__org_chart__1", "bar__plain__x"):
        with pytest.raises(ValueError):
            figures.regenerate(bad)
    full = figures.regenerate(a[0][0], ((1900, 1100),))
    assert full["width"] > 700 and full["height"] > 400  # nothing is shrunk to a bound


def test_first_valid_attempt_is_drawn(spark):
    """The kernel's choice of an attempt equals the one over all attempts in Spark."""
    tasks = spark.createDataFrame([(k, s, 3 + 7 * i) for i in range(50) for k, s in (("map", "pins"), ("scatter", "bubble"), ("bar", "plain"))], "label string, sub_type string, seed long")
    tried = figures.attempts(tasks).collect()
    want = {}
    for r in tried:
        if r["violation"] is None:
            key = (r["label"], r["sub_type"], r["seed"])
            want[key] = min(want.get(key, 9), r["attempt"])
        assert r["violation"] == synth.broken_rule(r["label"], r.asDict())
    got = {(r["label"], r["sub_type"], r["seed"]): r["retry"] for r in figures.samples(tasks, ((150, 210),)).collect() if r["error"] is None}
    assert got == want and max(got.values()) > 0


def test_sub_types_and_styles_are_drawn_apart():
    for label, subs in synth.SUBTYPES.items():
        if label == "other":
            continue
        for seed in range(6):
            rng = np.random.default_rng(seed)
            style = figures.style_sheet(rng) | {"title": True, "data_labels": True, "yaxis": True, "spines": "all"}
            specs = {x: figures.build_spec(label, x, np.random.default_rng(seed + 40)) for x in subs}
            made = {x: figures.raster(label, x, specs[x], style, 170, 130) for x in subs}
            assert all(m.shape == (130, 170, 3) for m in made.values())
            assert len({m.tobytes() for m in made.values()}) == len(subs), label
    spec = figures.build_spec("bar", "plain", np.random.default_rng(0))
    style = figures.style_sheet(np.random.default_rng(0)) | {"style_preset": "clean", "title": False, "data_labels": False, "yaxis": False, "spines": "none"}
    draw = lambda **p: figures.raster("bar", "plain", spec, style | p, 170, 130).tobytes()
    variants = [draw(), draw(title=True), draw(data_labels=True), draw(yaxis=True), draw(spines="bottom"), draw(spines="left_bottom"), draw(spines="all"), draw(style_preset="grid"), draw(style_preset="boxed")]
    assert len(set(variants)) == len(variants)


def test_every_recorded_loss_changes_pixels():
    rng = np.random.default_rng(5)
    img = np.clip(pixels.blur(rng.uniform(0, 255, (90, 130, 3)).astype(np.float32), 1.5), 0, 255)
    clean = {"severity": 0.0, "rotate": 0.0, "perspective": False, "hard_clip_side": "", "crop_inset": [0.0] * 4, "scale": 1.0, "blur_sigma": 0.0, "jpeg_quality": 95, "jpeg_passes": 1, "noise_sigma": 0.0, "greyscale": False, "gamma": 1.0, "contrast": 1.0}
    assert clean.keys() == figures.degrade_params(rng).keys()
    run = lambda **p: figures.degrade(img, clean | p, np.random.default_rng(1))
    base = run()
    assert base.shape == img.shape and np.abs(base - img).mean() < 6
    for p in ({"rotate": 0.5}, {"perspective": True}, {"blur_sigma": 0.4}, {"jpeg_quality": 40}, {"jpeg_passes": 2, "jpeg_quality": 40}, {"noise_sigma": 3.0}, {"greyscale": True}, {"gamma": 1.1}, {"contrast": 0.9}):
        out = run(**p)
        assert out.shape == base.shape and not np.array_equal(out, base), p
    assert run(jpeg_quality=40).tolist() != run(jpeg_quality=40, jpeg_passes=2).tolist()
    for side, shape in (("left", (90, 119, 3)), ("right", (90, 119, 3)), ("top", (82, 130, 3)), ("bottom", (82, 130, 3))):
        assert run(hard_clip_side=side).shape == shape
    assert run(crop_inset=[0.1, 0, 0, 0]).shape == (81, 130, 3) and run(scale=0.5).shape == (45, 65, 3)
    whole = np.rint(img)
    assert np.allclose(pixels.warp(whole, pixels.rotation(0.0, 90, 130), 255), whole, atol=1e-3)
    assert np.allclose(pixels.warp(whole, pixels.homography([(0, 0), (129, 0), (129, 89), (0, 89)], 90, 130), 0), whole, atol=0.05)
    quarter = pixels.warp(whole[:90, :90], pixels.rotation(90.0, 90, 90), 0)
    assert np.allclose(quarter, np.rot90(whole[:90, :90], 1), atol=0.05) or np.allclose(quarter, np.rot90(whole[:90, :90], 3), atol=0.05)
    assert np.allclose(pixels.resize(np.full((7, 9, 3), 40.0), 20, 4), 40) and abs(pixels.resize(img, 45, 65).mean() - img.mean()) < 1


def _jpeg(img, quality, sampling, restart=0):
    """A baseline JPEG by a plain encoder with flat Huffman tables, and what it must decode to."""
    zig, (h, w), out = pixels._zigzag(), img.shape[:2], bytearray()
    q = [t.reshape(64) for t in pixels.quantisers(quality)]
    dc = [(s, 4) for s in range(12)]
    ac = [(r << 4 | s, 8) for r in range(16) for s in range(11) if s or r in (0, 15)]
    code = lambda table: {s: (k, n) for k, (s, n) in enumerate(table)}
    dc_code, ac_code, bits = code(dc), code(ac), []

    def put(v, n):
        bits.extend(v >> (n - 1 - i) & 1 for i in range(n))

    def number(v):
        n = abs(int(v)).bit_length()
        return n, int(v) if v >= 0 else int(v) + (1 << n) - 1

    def flush():
        bits.extend([1] * (-len(bits) % 8))
        for i in range(0, len(bits), 8):
            b = int("".join(map(str, bits[i : i + 8])), 2)
            out.append(b)
            out.extend([0] if b == 255 else [])
        bits.clear()

    ycc = np.moveaxis(img.astype(np.float32) @ pixels.YCC.T, -1, 0)
    ycc[0] -= 128
    hs, vs = sampling
    mh, mw = -(-h // (8 * vs)), -(-w // (8 * hs))
    pad = np.pad(ycc, ((0, 0), (0, mh * 8 * vs - h), (0, mw * 8 * hs - w)), mode="edge")
    planes = [pad[0], *(p.reshape(mh * 8, vs, mw * 8, hs).mean((1, 3)) for p in pad[1:])]
    before, back = [0, 0, 0], [np.zeros_like(p) for p in planes]
    for mcu in range(mh * mw):
        if restart and mcu and mcu % restart == 0:
            flush()
            out.extend((0xFF, 0xD0 + (mcu // restart - 1) % 8))
            before = [0, 0, 0]
        for k in range(3):
            for j in range(hs * vs if k == 0 else 1):
                r, c = (mcu // mw * vs + j // hs, mcu % mw * hs + j % hs) if k == 0 else (mcu // mw, mcu % mw)
                at = (slice(8 * r, 8 * r + 8), slice(8 * c, 8 * c + 8))
                own = q[min(k, 1)]
                coef = np.rint((pixels._DCT @ planes[k][at] @ pixels._DCT.T).reshape(64) / own)
                back[k][at] = pixels._DCT.T @ (coef * own).reshape(8, 8) @ pixels._DCT
                v = coef[zig].astype(int)
                n, x = number(v[0] - before[k])
                before[k] = v[0]
                put(*dc_code[n])
                put(x, n)
                run, last = 0, max(np.flatnonzero(v[1:]) + 1, default=0)
                for i in range(1, last + 1):
                    if not v[i]:
                        run += 1
                        continue
                    while run > 15:
                        put(*ac_code[0xF0])
                        run -= 16
                    n, x = number(v[i])
                    put(*ac_code[run << 4 | n])
                    put(x, n)
                    run = 0
                if last < 63:
                    put(*ac_code[0])
    flush()
    seg = lambda m, body: b"\xff" + bytes([m]) + (len(body) + 2).to_bytes(2, "big") + body
    table = lambda kind, t: bytes([kind]) + bytes(sum(n == i for _, n in t) for i in range(1, 17)) + bytes(s for s, _ in t)
    head = b"\xff\xd8" + seg(0xDB, b"".join(bytes([k]) + bytes(t[zig].astype(np.uint8)) for k, t in enumerate(q)))
    head += seg(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3, 1, hs << 4 | vs, 0, 2, 0x11, 1, 3, 0x11, 1])) + seg(0xC4, table(0, dc) + table(16, ac))
    head += seg(0xDD, restart.to_bytes(2, "big")) if restart else b""
    whole = np.stack([back[0], *(p.repeat(vs, 0).repeat(hs, 1) for p in back[1:])], -1)[:h, :w]
    return head + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + bytes(out) + b"\xff\xd9", whole + (128, 0, 0)


@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (2, 2)])
def test_jpeg_decoding(sampling):
    img = np.clip(pixels.blur(np.random.default_rng(3).uniform(0, 255, (37, 50, 3)).astype(np.float32), 2.0) * 1.5 - 40, 0, 255)
    for restart in (0, 3):
        data, want = _jpeg(img, 80, sampling, restart)
        got = pixels.decode(data)
        assert got.shape == img.shape and np.abs(got - np.clip(want @ pixels._RGB.T, 0, 255)).max() <= 1.5
    for bad in (b"", b"\xff\xd8\xff", data[:200], data[:-300], b"GIF89a"):
        with pytest.raises((ValueError, IndexError, StopIteration, KeyError)):
            pixels.decode(bad)


def test_photos_are_augmented(spark):
    rng = np.random.default_rng(2)
    img = np.clip(pixels.blur(rng.uniform(0, 255, (80, 120, 3)).astype(np.float32), 3.0), 0, 255).astype(np.uint8)
    photos = spark.createDataFrame([(0, "/x/r1__p1__a.png", "r1", bytearray(pixels.png(img))), (1, "/x/r2__b.jpg", "r2", bytearray(_jpeg(img, 90, (2, 2))[0])), (2, "/x/r2__c.jpg", "r2", bytearray(b"junk")), (3, "/x/out__d.png", "out", bytearray(pixels.png(img)))], "i long, path string, report string, content binary")
    plan = synth.photo_plan(photos, spark.createDataFrame([("out",), ("out",)], "report string"), 3, 7)
    got = {(r["crop_id"], r["aug_index"]): r for r in figures.photo_samples(plan, ((200, 160), (300, 170))).collect()}
    assert len(got) == 9 and sum(r["error"] is not None for r in got.values()) == 3
    one = [got[f"photo__r1__r1__p1__a__a{k}", k] for k in range(3)]
    assert len({bytes(r["image"]) for r in one}) == 3 and all(pixels.decode(bytes(r["image"])).shape[:2] == (r["height"], r["width"]) for r in one)
    left = synth.reports_left(photos, spark.createDataFrame([("out",), ("r1",)], "report string")).first()
    assert tuple(left) == (4, 3, 2, 1, False)


def test_contact_sheet_cells():
    good = pixels.png(np.zeros((300, 20, 3), np.uint8))
    sheet = pixels.decode_png(figures.contact_sheet([good, b"junk", good], cols=2, cell=50, marks=["bar", "map", "bar"]))
    assert sheet.shape == (112, 100, 3) and tuple(sheet[25, 25]) == (0, 0, 0) and tuple(sheet[0, 50]) == (200, 60, 60)
    assert tuple(sheet[52, 10]) == tuple(sheet[108, 10]) != tuple(sheet[52, 60])
    with pytest.raises(ValueError):
        figures.contact_sheet([])


def test_manifest_appends_and_indexes_round_trip(spark, tmp_path):
    from pyspark.sql import Row

    m = str(tmp_path / "m")
    old = spark.createDataFrame([Row(filename=f"{i:03d}.png", page=i) for i in range(400)]).repartition(5)
    sinks.write_manifest(old, m)
    for k in range(3):
        sinks.write_manifest(spark.createDataFrame([Row(filename="007.png", page=1000 + k), Row(filename="new.png", page=k)]), m, append=True)
    got = {r["filename"]: r["page"] for r in records.read_manifest(spark, m).collect()}
    assert len(got) == 401 and got["007.png"] == 1002 and got["new.png"] == 2 and got["008.png"] == 8
    lines = [r["value"] for r in records.read_lines(spark, m).orderBy("ord").collect()]
    sinks.rewrite_lines(records.read_lines(spark, m), m)
    assert [r["value"] for r in records.read_lines(spark, m).orderBy("ord").collect()] == lines
    sinks.write_manifest(spark.createDataFrame([Row(filename="008.png", page=5)]), m, append=True)
    assert {r["filename"]: r["page"] for r in records.read_manifest(spark, m).collect()}["008.png"] == 5
    backups = {sinks.write_manifest(old, m) for _ in range(3)}
    assert len(backups) == 3 and all(sinks.exists(spark, b) for b in backups)
    idx = spark.createDataFrame([("p", "bar", "train", "real", "d"), ("q", "zebra", "train", "synth", None), ("r", "map", "val", "real", "e")], records.INDEX)
    sinks.write_index(idx, str(tmp_path / "i"))
    known, unknown = records.read_index(spark, str(tmp_path / "i"), "train")
    assert [tuple(r) for r in known.collect()] == [("p", 0)] and unknown.first()["label"] == "zebra"
    assert records.read_index(spark, str(tmp_path / "i"), "val", "real")[0].count() == 1 and records.read_index(spark, str(tmp_path / "i"), "train", "synth")[0].count() == 0


def test_moves_stay_below_the_root(spark):
    rows = [(1, "/etc/x.png", "in", "bar"), (2, "x.png", "/abs", "bar"), (3, "x.png", "in", "/abs"), (4, "a..b.png", "in", "c..d"), (5, "x.png", "in", "bar/../map"), (6, "../in/y.png", "in", "bar"), (7, "../../y.png", "in", "bar"), (8, "y.png", "in", "..")]
    here = spark.createDataFrame([("x.png", "in"), ("y.png", "in"), ("a..b.png", "in")], "file string, folder string")
    rep = {r["ord"]: r["reason"] for r in manifest.commit_moves(spark.createDataFrame(rows, "ord long, file string, `from` string, `to` string"), here).collect()}
    escapes = "path escapes root"
    assert rep == {1: escapes, 2: escapes, 3: escapes, 4: None, 5: None, 6: "already exists in bar", 7: escapes, 8: escapes}
    lines = [(0, '{"filename": "a.png", "note": "\\"manual_root\\": x", "manual_root": "o\\"ld", "k": 1}'), (1, '{"filename": "b.png"}'), (2, "{}"), (3, '{"filename": "c.png", "manual_root": null}')]
    odd = ['c$1\\2', 'q"z', 'tab\there']
    report = spark.createDataFrame([(i, f"{n}.png", t, True) for i, (n, t) in enumerate(zip("abc", odd, strict=True))], "ord long, file string, to string, moved boolean")
    out = manifest.patch_manifest(spark.createDataFrame(lines, "ord long, value string"), report).orderBy("ord").collect()
    for (_, before), r, to in zip(lines, out, (odd[0], odd[1], None, odd[2]), strict=True):
        assert json.loads(r["value"]) == json.loads(before) | ({"manual_root": to} if to else {})


def test_replace_never_loses_what_was_there(spark, tmp_path, monkeypatch):
    (tmp_path / "old").mkdir()
    (tmp_path / "old/f").write_text("old")
    with pytest.raises(OSError):
        sinks.replace(spark, str(tmp_path / "missing"), str(tmp_path / "old"))
    assert (tmp_path / "old/f").read_text() == "old"
    (tmp_path / "new").mkdir()
    (tmp_path / "new/f").write_text("new")
    sinks.replace(spark, str(tmp_path / "new"), str(tmp_path / "old"))
    assert (tmp_path / "old/f").read_text() == "new" and [p.name for p in tmp_path.iterdir()] == ["old"]


def test_only_missing_folders_are_empty(spark, tmp_path):
    assert files.scan(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="nosuchscheme"):
        files.scan(spark, "nosuchscheme://x/y")


def test_reply_clients_run_together_and_back_off(spark):
    import time

    plan = judge.call_plan(spark.createDataFrame([("a",), ("b",)], "file string"), 6).coalesce(1)

    def call(file):
        time.sleep(0.3)
        if file == "b":
            raise RuntimeError("down")
        return "ok", None, None

    began = time.time()
    got = scoring.score_replies(plan, call, retries=1, concurrency=12, pause=0.1).collect()
    assert time.time() - began < 3 and len(got) == 12  # one after another: 5.4 s and more
    assert {(r["file"], r["error"], r["attempts"], r["cost"]) for r in got} == {("a", None, 1, None), ("b", "RuntimeError: down", 2, None)}


def test_fine_tuning_schedule(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 1, (13, 64))
    rows = [(i, [float(v) for v in centre[i % 13] + rng.normal(0, 0.3, 64)], i % 13) for i in range(390)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>, target int")
    train, val = df.filter("id % 3 <> 0"), df.filter("id % 3 = 0")
    one, _ = scoring.fine_tune(train, val, epochs=1)
    assert np.array_equal(one.backbone, np.eye(64)) and one.groups(0.1, 0.2, True)[0] == ("backbone", 0.0) and one.groups(0.1, 0.2, False)[0] == ("backbone", 0.1)
    net, history = scoring.fine_tune(train, val, epochs=4)
    assert not np.array_equal(net.backbone, np.eye(64)) and len(history) == 4
    assert history[-1]["train_loss"] < history[0]["train_loss"] and history[-1]["val_macro_f1"] > 0.9
    seen = scoring.evaluate(val, net)
    assert abs(seen["loss"] - min(h["val_loss"] for h in history)) < 1e-5
    p = net(np.array([r[1] for r in rows if r[0] % 3 == 0]))
    y = np.array([r[2] for r in rows if r[0] % 3 == 0])
    assert abs(seen["loss"] + np.log(p[np.arange(len(y)), y]).mean()) < 1e-6 and abs(seen["acc"] - (p.argmax(1) == y).mean()) < 1e-9
    again, more = scoring.fine_tune(train, None, epochs=2, start=net, freeze_epochs=0)
    assert math.isnan(more[0]["val_loss"]) and more[-1]["train_loss"] < history[-1]["train_loss"] and again is not net
    assert math.isnan(scoring.evaluate(val.filter("1 = 0"), net)["macro_f1"])
    _, stopped = scoring.fine_tune(train, val, epochs=9, head_rate=0.0, backbone_rate=0.0, patience=2)
    assert len(stopped) == 3


def test_figures_and_reports_are_written(spark, raw, tmp_path):
    import xml.etree.ElementTree as ET

    runs = judge.tidy(raw[0])
    names = sinks.write_plots(runs, str(tmp_path))
    assert set(names) == set(judge.PLOT_FRAMES) and sinks.write_plots(runs.filter("1 = 0"), str(tmp_path / "none")) == names
    texts = {n: (tmp_path / f"{n}.svg").read_text() for n in names}
    assert all(ET.fromstring(t).tag.endswith("svg") for t in texts.values()) and "pie_donut" in texts["confusion"]
    order = [r["label"] for r in judge.worst_classes(runs).collect()]
    at = [texts["class_accuracy"].index(f">{x}<") for x in order]
    assert at == sorted(at) and [r["recall"] for r in judge.worst_classes(runs).collect()] == sorted(r["recall"] for r in judge.per_class(runs).collect())
    history = [{"epoch": e, "train_loss": 2.0 / e, "val_loss": float("nan") if e == 2 else 2.5 / e, "val_acc": 0.5, "val_macro_f1": 0.4} for e in (1, 2, 3)]
    sinks.write_history(spark, history, str(tmp_path))
    assert (tmp_path / "history.csv").read_text().splitlines()[1] == "1,2.0,2.5,0.5,0.4" and ET.fromstring((tmp_path / "loss_curve.svg").read_text()) is not None
    sinks.write_benchmark_plot(spark.createDataFrame([(0, 0, 9), (0, 1, 1)], "target int, pred int, n long"), str(tmp_path / "b.svg"), "test")
    assert ">9<" in (tmp_path / "b.svg").read_text()
    made = [("bar", "plain", "blue_03", "none", False, 0.05, 0, 200, 100, (False, 2, True, False)), ("bar", "plain", "blue_11", "all", True, 0.5, 1, 300, 100, (True, 1, False, False)), ("map", "pins", "red_01", "all", True, 0.2, 0, 400, 200, None)]
    df = spark.createDataFrame(made, "label string, sub_type string, palette string, spines string, yaxis boolean, severity double, retry int, width int, height int, degrade struct<hard_clip: boolean, jpeg_passes: int, greyscale: boolean, perspective: boolean>")
    text = sinks.write_stats(df, str(tmp_path / "stats.md"), df.select("width", "height"), "m")
    assert "| `bar` | 2 | 66.7 % |" in text and text.index("`bar`") < text.index("`map`") and "| `blue` | 2 |" in text
    assert "| width, real | 200 | 200 | 300 | 300 | 300 | 3 |" in text and "| clipped | 50.0 |" in text and "| 1 | 33.3333 |" in text
    with pytest.raises(ValueError):
        qa.stats_report(df.filter("1 = 0"))
    (tmp_path / "s.jsonl").write_text('{"label": "bar"}\n\n{"label": 3')
    with pytest.raises(Exception, match="FAILFAST"):
        records.read_strict(spark, str(tmp_path / "s.jsonl"), "label string").collect()
    both = records.union_manifests(df.select("label", "retry"), df.select("label", "width"))
    assert both.columns == ["label", "retry", "width"] and both.filter("width IS NULL").count() == 3
    fails = judge.failures(runs).withColumn("content", F.lit("raw reply"))
    sinks.dump_failures(fails, str(tmp_path / "dumps"))
    assert len([p for p in (tmp_path / "dumps").iterdir() if p.name.startswith("stem=")]) == fails.count()
    assert "raw reply" in next((tmp_path / "dumps").glob("stem=*/*.txt")).read_text()


def test_regions_of_documents(spark):
    page = np.zeros((200, 300, 3), np.uint8)
    page[20:60, 40:100] = (255, 0, 0)
    assert regions.render_region(page, (20, 70, 50, 90), 2.0).mean(axis=(0, 1)).tolist() == [255, 0, 0]
    assert regions.render_region(page, (50, 90, 20, 70), 2.0).shape == (40, 60, 3) and regions.render_region(page, (20, 300, 50, 290), 2.0) is None
    built = []

    def build(config):
        built.append(config)

        def extract(path, content):
            if not content:
                raise ValueError("empty")
            return [{"page": 1, "kind": "table", "left": 20.0, "top": 90.0, "right": 50.0, "bottom": 70.0}, {"page": 1, "kind": "picture"}, {"page": 2, "kind": "table", "left": 0.0, "top": 1.0, "right": 1.0, "bottom": 0.0}]

        return extract

    docs = spark.createDataFrame([("a.pdf", bytearray(b"x")), ("b.pdf", bytearray(b""))], "path string, content binary")
    got = regions.extract_documents(docs, build, regions.ExtractorConfig(scale=2.0))
    assert sorted((r["source_pdf"], r["number"], r["error"]) for r in got.filter("error IS NULL").collect()) == [("a.pdf", 1, None), ("a.pdf", 2, None), ("a.pdf", 3, None)]
    assert got.filter("error IS NOT NULL").first()["error"] == "ValueError: empty"
    crops = regions.table_crops(got, spark.createDataFrame([("a.pdf", 1, bytearray(pixels.png(page)))], "source_pdf string, page long, image binary")).collect()
    assert [(r["page"], r["number"], r["width"], r["height"]) for r in crops] == [(1, 1, 60, 40)]


def test_labelling_service(spark, tmp_path):
    import gzip
    import threading
    import urllib.error
    import urllib.request
    from http.server import ThreadingHTTPServer

    from plumbline.sources import service as S

    for n in ("bar/a.png", "bar/B.PNG", "map/c.png", "bar/n.txt", "_review/d.png"):
        (tmp_path / "root" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / n).write_bytes(pixels.png(np.zeros((4, 4, 3), np.uint8)))
    (tmp_path / "root/m.jsonl").write_text('{"filename": "a.png", "page": 3, "raw_label": "icon"}\n{"filename": "x.png"}\n')
    root, manifest_path = str(tmp_path / "root"), str(tmp_path / "root/m.jsonl")
    service = S.Service(spark, root, manifest_path)
    assert service.folders(root)["folders"] == [{"name": "_review", "count": 1}, {"name": "bar", "count": 2}, {"name": "map", "count": 1}]
    assert service.check(root, manifest_path, "bar")["manifest"] == {"path": manifest_path, "exists": True, "status": "ok", "matched": 1, "checked": 2}
    assert service.check(root, manifest_path, "map")["manifest"]["status"] == "no_match" and service.check(root)["manifest"]["status"] == "none"
    listed = service.images(root, "bar", manifest_path)["images"]
    assert [x["file"] for x in listed] == ["a.png", "B.PNG"] and len(listed[0]["meta"]) == 11
    assert listed[0]["meta"]["page"] == 3 and listed[0]["meta"]["in_manifest"] and not listed[1]["meta"]["in_manifest"]
    for bad in (("bar", ".."), ("bar", "../../etc"), ("bar", "/etc"), ("none",)):
        with pytest.raises(S.NotFound):
            service.images(root, "/".join(bad) if bad[0] == "none" else bad[1])
    server = ThreadingHTTPServer(("127.0.0.1", 0), S.handler(service))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    get = lambda p: urllib.request.urlopen(url + p)
    try:
        assert json.load(get("/api/defaults")) == {"root": root, "manifest": manifest_path}
        assert get(f"/img?root={root}&sub=bar&file=a.png").read()[:4] == b"\x89PNG"
        with pytest.raises(urllib.error.HTTPError) as e:
            get("/api/none")
        assert e.value.code == 404
        body = json.dumps({"root": root, "manifest": manifest_path, "moves": [{"file": "a.png", "from": "bar", "to": "line"}, {"file": "a.png", "from": "line", "to": "map"}, {"file": "c.png", "from": "map", "to": "../up"}, {"file": "B.PNG", "from": "bar", "to": "map"}]}).encode()
        done = json.load(urllib.request.urlopen(urllib.request.Request(f"{url}/api/commit", body)))
        assert [m["to"] for m in done["moved"]] == ["line", "map", "map"] and done["skipped"] == [{"file": "c.png", "reason": "path escapes root"}]
        assert done["manifest_updated"] == 1 and done["manifest_no_record"] == ["B.PNG"] and (tmp_path / "root/map/a.png").exists()
        assert records.read_manifest(spark, manifest_path).filter("filename = 'a.png'").first()["manual_root"] == "map"
        for i in range(60):
            (tmp_path / f"root/map/long_name_of_an_image_{i}.png").write_bytes(b"x")
        squeezed = urllib.request.urlopen(urllib.request.Request(f"{url}/api/images?root={root}&sub=map", headers={"Accept-Encoding": "gzip"}))
        assert squeezed.headers["Content-Encoding"] == "gzip" and len(json.loads(gzip.decompress(squeezed.read()))["images"]) == 63
    finally:
        server.shutdown()


def test_greedy_assignment_against_plain_loops(spark):
    """The choice document by document, written out."""
    rng = random.Random(8)
    rows = [(f"d{d}__{i}.png", rng.choice(tax.LABELS), f"d{d}", "real", "train") for d in range(14) for i in range(rng.randint(1, 12))]
    index = spark.createDataFrame(rows, "path string, label string, doc string, source string, split string")
    docs = {}
    for _, lab, d, *_ in rows:
        docs.setdefault(d, []).append(lab)
    total = len(rows)
    for existing in ({}, {"d3": "val", "d5": "train", "gone": "val"}):
        placed = {d: s for d, s in existing.items() if d in docs}
        draws = random.Random(4)
        for d in sorted((d for d in docs if d not in placed), key=lambda d: (-len(docs[d]), d)):
            order = ["train", "val"]
            draws.shuffle(order)
            score = {}
            for s, share, bonus in (("train", 0.8, 0.1), ("val", 0.2, 0.5)):
                mine = [x for k, t in placed.items() if t == s for x in docs[k]]
                score[s] = (share * total - len(mine)) / (share * total) + bonus * len(set(docs[d]) - set(mine)) / 13
            placed[d] = order[0] if score[order[0]] >= score[order[1]] else order[1]
        assert split.assign_docs(index, existing=existing, seed=4) == placed


def test_other_figures_are_drawn(spark):
    assert set(figures.OTHER_MARKS) == set(synth.SUBTYPES["other"])
    for sub in synth.SUBTYPES["other"]:
        seen = set()
        for seed in range(24):
            rng = np.random.default_rng(seed)
            spec = figures.build_spec("other", sub, rng)
            img = figures.raster("other", sub, spec, figures.style_sheet(rng), 90 + seed, 70)
            assert img.shape == (70, 90 + seed, 3) and len({k for k, _, _ in spec["inside"]}) == len(spec["inside"])
            assert sub == "blank_artifact" or (img != img[-1, 0]).any(), (sub, seed)
            seen.add(img.tobytes())
        assert len(seen) > 12, sub
    planned = registry.QUERIES["synth_task_plan"](spark, "/root/testdata/sf0.001").filter("label = 'other'").count()
    drawn = registry.QUERIES["synth_render"](spark, "/root/testdata/sf0.001").filter("label = 'other'").collect()
    assert len(drawn) == planned > 0 and all(r["error"] is None and r["n_bytes"] > 0 for r in drawn)


def test_pictures_are_degraded_in_strips(monkeypatch):
    """Strips change no pixel, and what they need besides the picture is a few planes."""
    import tracemalloc

    rng = np.random.default_rng(6)
    p = figures.degrade_params(rng) | {"rotate": 0.7, "perspective": True, "scale": 1.0, "blur_sigma": 0.8, "jpeg_passes": 2, "noise_sigma": 3.0, "greyscale": False, "hard_clip_side": ""}
    for shape in ((211, 133, 3), (64, 160, 3), (7, 5, 3)):
        img = rng.integers(0, 256, shape, dtype=np.uint8)
        got = []
        for strip in (1, 1 << 11, 1 << 30):
            monkeypatch.setattr(pixels, "STRIP", strip)
            got.append(figures.degrade(img, p, np.random.default_rng(2)).astype(int))
        assert all(np.abs(x - got[0]).max() <= 4 and (x != got[0]).mean() < 1e-3 for x in got[1:])
        planes = np.moveaxis(pixels.warp(img, np.eye(3), 0), -1, 0)
        assert np.array_equal(planes, np.moveaxis(img, -1, 0))
    monkeypatch.undo()
    img = rng.integers(0, 256, (900, 1200, 3), dtype=np.uint8)
    tracemalloc.start()
    try:
        figures.degrade(img, p, np.random.default_rng(2))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 * 900 * 1200


def test_class_count_plans(tmp_path):
    def plan(s):
        (tmp_path / "p.yaml").write_text(s)
        return records.load_class_counts(str(tmp_path / "p.yaml"))

    assert plan("bar: 3\nmap: 0\n") == {"bar": 3, "map": 0}
    assert records.plan_gaps({"bar": 3, "map": 0})[1] == ["map"]
    for bad in ("", "- bar\n", "zebra: 1\n", "bar: -1\n", "bar: true\n", "bar: 1.5\n", "bar: 0\n"):
        with pytest.raises(ValueError):
            plan(bad)


def test_trees_and_sinks(spark, tmp_path):
    for name in ("bar/a__p1__1.PNG", "bar/b__p1__2.png", "_review/c__1.png", "map/d.txt", "x.pdf", "photo/r__1.jpg"):
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"\x89PNG")
    root = str(tmp_path / "tree")
    tree = files.review_tree(spark, root).collect()
    assert sorted((r["doc"], r["label"]) for r in tree) == [("a", "bar"), ("b", "bar"), ("r", "photo")]
    images, empty = files.judge_set(spark, root)
    assert images.count() == 3 and empty.count() == 11
    assert files.synth_tree(spark, str(tmp_path / "none")).count() == 0
    assert files.documents(spark, root, 1).count() == 1 and files.photos(spark, root).count() == 4
    assert {r["folder"]: r["images"] for r in files.folder_counts(spark, root).collect()} == {"bar": 2, "_review": 1, "photo": 1}
    assert [r["name"] for r in files.listing(spark, root, "bar").collect()] == ["a__p1__1.PNG", "b__p1__2.png"]
    assert files.images(spark, root + "/photo").first()["data_url"].startswith("data:image/jpeg;base64,")
    rows = spark.createDataFrame([("a", "bar", None), ("b", "map", None)], "crop_id string, label string, error string")
    with pytest.raises(sinks.SplitError):
        sinks.write_samples(rows, str(tmp_path / "s"), split="val")
    sinks.write_samples(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("label = 'map'").count() == 1
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        sinks.write_samples(rows.withColumn("label", F.lit("zebra")), str(tmp_path / "t"))
    idx = spark.createDataFrame([("p", "bar", "train", "real", "d"), ("q", "zebra", "train", "synth", None), ("r", "map", "val", "real", "e")], records.INDEX)
    idx.write.json(str(tmp_path / "i.json"))
    known, unknown = records.read_index(spark, str(tmp_path / "i.json"), "train")
    assert [tuple(r) for r in known.collect()] == [("p", 0)] and unknown.first()["label"] == "zebra"
    sinks.write_assignments(spark.createDataFrame([("b", "val"), ("a", "train")], "doc string, split string"), str(tmp_path / "a.json"))
    assert records.read_assignments(spark, str(tmp_path / "a.json")) == {"a": "train", "b": "val"}
    m = str(tmp_path / "m")
    assert sinks.write_manifest(rows, m) is None and sinks.write_manifest(rows, m) is not None
    routed = spark.createDataFrame([("x", None, "bar"), ("y", "too_small_3x4", None)], "id string, reason string, routed_to string")
    sinks.write_routed(routed, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/junk")).first()["kind"] == "too_small"


def test_report_and_run_files(spark, raw, tmp_path):
    df, _ = raw
    df.write.json(str(tmp_path / "run"))
    runs = records.read_runs(spark, str(tmp_path / "run"))
    assert runs.count() == df.count()
    out = sinks.write_report(judge.report(df), judge.validate(df), str(tmp_path / "rep"))
    assert json.loads((tmp_path / "rep/metrics.json").read_text())["blocks"].keys() == out.keys()
    assert "## overall" in (tmp_path / "rep/report.md").read_text()
    assert sinks.jsonable({"a": [float("nan"), 1.0]}) == {"a": [None, 1.0]}
    sinks.dump_failures(judge.failures(runs), str(tmp_path / "fail"))
    (tmp_path / "bad.jsonl").write_text('{"file": "bar/1.png"}\n{broken\n')
    with pytest.raises(Exception, match="FAILFAST"):
        records.read_runs(spark, str(tmp_path / "bad.jsonl")).collect()


def test_streams(spark, tmp_path):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    rows = [(t + datetime.timedelta(hours=i), f"f{i % 4}", i // 4 % 2, 1 if i % 3 else None, bool(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, file string, call_idx int, pred int, ok boolean")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = streams.run_to_table(streams.windowed_accuracy(s)).orderBy("start").collect()
    assert [r["n_calls"] for r in got] == [24, 24, 12]
    streams.append_to(streams.first_seen(s, "30 days"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_regions(spark):
    p = spark.createDataFrame([(1, "<p><TABLE x><img src=a><b>"), (2, "plain"), (3, None)], "page_id int, html string")
    assert [tuple(r)[:3] for r in regions.extract_regions(p).collect()] == [(1, 1, "table"), (1, 2, "picture")]


def test_layout_and_draws(spark):
    from plumbline.functions import draws, layout

    t = "one three seventeen  a b incomprehensibilities x"
    got = spark.range(1).select(layout.wrap(F.lit(t), 9).alias("w"), layout.shrink(F.lit(100.0), F.lit(60.0)).alias("s"), layout.stack_totals(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))).alias("c"), layout.spread_meta(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("9"))).alias("m")).first()
    assert got["w"] == ["one three", "seventeen", "a b", "incomprehensibilities", "x"]
    assert 55 < got["s"] <= 60 and got["c"] == [4.0, 6.0] and got["m"] == {"a": "9", "b": "2"}
    u = spark.range(4000).select(draws.unit(F.col("id"), "x").alias("u"), draws.unit(F.col("id"), "y").alias("v"))
    r = u.select(F.avg("u").alias("m"), F.stddev(draws.normal(F.col("u"), F.col("v"))).alias("s"), F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert abs(r["m"] - 0.5) < 0.02 and abs(r["s"] - 1) < 0.05 and 0 <= r["lo"] and r["hi"] < 1
    p = spark.range(50).select(draws.sample(F.array(*map(F.lit, "abcdef")), F.col("id"), "s", 3).alias("s")).collect()
    assert all(len(set(x["s"])) == 3 for x in p) and len({tuple(x["s"]) for x in p}) > 20


def test_small_services(spark, tmp_path):
    head = scoring.SoftmaxHead(np.ones((2, 13)), np.arange(13.0))
    scoring.save_head(spark, head, str(tmp_path / "h.json"))
    assert np.array_equal(scoring.load_head(spark, str(tmp_path / "h.json")).bias, head.bias)
    (tmp_path / "r").mkdir()
    (tmp_path / "r/run.jsonl").write_text("")
    assert records.resolve_run(spark, str(tmp_path / "r")).endswith("run.jsonl")
    with pytest.raises(FileNotFoundError):
        records.resolve_run(spark, str(tmp_path / "gone"))
    assert synth.select_classes({"bar": 2, "map": 0, "photo": 3}) == {"bar": 2}
    with pytest.raises(ValueError):
        synth.select_classes({"zebra": 1})
    images = spark.createDataFrame([("bar", "a"), ("bar", "b"), ("_review", "c"), ("map", "d")], "label string, path string")
    got = [(r["label"], r["n"]) for r in sinks.collect_labeled(images, str(tmp_path / "c")).collect()]
    assert got == [("TOTAL", 3), ("bar", 2), ("map", 1)]
    sinks.write_meta(spark, str(tmp_path / "meta.json"), {"n": 1}, {"x": float("nan")})
    assert json.loads((tmp_path / "meta.json").read_text())["results"] == {"x": None}
    names = spark.createDataFrame([("runs/20240131_120000_x",), ("other",)], "f string").select(text.run_stamp(F.col("f")).cast("string"), text.share_label(F.lit(1), F.lit(3))).collect()
    assert names[0][:] == ("2024-01-31 12:00:00", "1 (33.3 %)") and names[1][0] is None


def test_figures_cost_what_they_show(monkeypatch):
    """Blocks of one colour are worn once a colour, with the same pixels as all blocks on their own; noise
    costs no search for repeats in the file and makes it no larger."""
    spec, style = figures.build_spec("bar", "plain", np.random.default_rng(3)), figures.style_sheet(np.random.default_rng(4))
    paper = figures._rgb(style["background"])
    img = figures.raster("bar", "plain", spec, style, 603, 411)
    packed = pixels.packed(img)
    assert np.array_equal(packed, figures.canvas("bar", "plain", spec, style, 603, 411))
    plan, seen = pixels._plan, []
    for back, size in ((np.eye(3), (411, 603)), (pixels.rotation(1.5, 411, 603), (411, 603)), (np.diag([1.4, 1.4, 1.0]), (290, 430)), (pixels.homography([(5, 3), (600, 1), (598, 409), (2, 405)], 411, 603), (411, 603))):
        for sigma, qualities in ((0.0, [60]), (1.1, [80, 55])):
            monkeypatch.setattr(pixels, "_plan", lambda *a: seen.append(plan(*a)) or seen[-1])
            got = pixels.worn(packed, back, paper, size, sigma, qualities)
            monkeypatch.setattr(pixels, "_plan", lambda *a: (np.arange(len(plan(*a)[1])),) * 2)
            want = pixels.worn(img, back, paper, size, sigma, qualities)
            assert got.shape == (*size, 3) and (got != want).mean() < 1e-4 and np.abs(got.astype(int) - want).max() <= 4
    assert all(len(todo) < 0.85 * len(which) for todo, which in seen) and sum(len(todo) for todo, _ in seen) < 0.7 * sum(len(which) for _, which in seen)
    flat = pixels.noisy(np.full((200, 300, 3), 128, np.uint8), 2.0, np.random.default_rng(1), False, np.arange(256, dtype=np.uint8)).astype(float)
    assert abs(flat.mean() - 127.5) < 0.02 and abs(flat.std() - math.sqrt(4 + 1 / 12)) < 0.02 and abs(np.corrcoef(flat[:, :-1].ravel(), flat[:, 1:].ravel())[0, 1]) < 0.02
    noisy = pixels.noisy(got, 2.0, np.random.default_rng(2), False, np.arange(256, dtype=np.uint8))
    rows = np.diff(noisy.reshape(len(noisy), -1), axis=0, prepend=np.zeros((1, noisy[0].size), np.uint8))
    least = len(zlib.compress(rows.tobytes(), 2))
    monkeypatch.setattr(pixels.zlib, "compress", None)
    data = pixels.png(noisy)
    assert len(data) < least and np.array_equal(pixels.decode_png(data), noisy)
    for counts in (np.zeros(256, int), 2 ** np.arange(256).clip(0, 40)):
        for n in (0, 1, 2, 3, 5, 70_001):
            raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
            assert zlib.decompress(pixels._literals(raw, counts)) == raw.tobytes()


def test_digests_are_those_of_the_files(spark):
    """The files of a query that returns only their sums stay in the tasks; a failing figure has none."""
    few = spark.createDataFrame([("bar", "plain", 5), ("map", "pins", 6)], "label string, sub_type string, seed long")
    for size in ((150.0, 210.0), (math.inf, 210.0)):
        files = {r["crop_id"]: r for r in figures.samples(few, (size,)).collect()}
        got = figures.digests(few, (size,))
        assert dict(got.dtypes)["n_bytes"] == "int" and "image" not in got.columns
        rows = got.collect()
        assert len(rows) == len(files) == 2 and {r["error"] is None for r in rows} == {size[0] == 150}
        for r in rows:
            file = files[r["crop_id"]]
            assert all(r[c] == file[c] for c in ("label", "retry", "width", "height", "severity", "error"))
            assert (r["n_bytes"], r["image_sha256"]) == ((None, None) if file["image"] is None else (len(file["image"]), hashlib.sha256(bytes(file["image"])).hexdigest()))
