"""Operators on small tables with known results."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from kindred.functions import similarity as sim
from kindred.operators import blocking, clustering, groups, lsh, matching, metrics, pairs, resolve, roc, sampling
from kindred.operators.components import connected_components
from kindred.sources import annotated
from kindred.spec import Feature

FILE = """Owner,Site,Seen,Age,Phone,Pics,Note
int,string,date,int,int,string,ignore
strong,weak,weak,weak,strong,weak,weak
block,block,noblock,block;block+1,block,block,block
binary_match,binary_match,special_date_difference,numerical_difference,binary_match,number_matches,binary_match
1,a,2021-03-04 05:06:07,22.9,5550100,x.jpg;y.jpg;z.jpg,n
2,b;a,none,,5550200,,n
3,NULL,2021-03-05 05:06:06,30;31,,x.jpg,n
1,a,bad,22,5550200,,n
"""


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "records.csv"
    path.write_text(FILE)
    records, features = annotated.read_annotated(spark, str(path))
    return records.cache(), features


def partition(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster_id"], set()).add(r["record_id"])
    return {frozenset(v) for v in out.values()}


def test_reading(spark, loaded, tmp_path):
    records, features = loaded
    assert [f.name for f in features] == ["Owner", "Site", "Seen", "Age", "Phone", "Pics"]
    rows = {r["record_id"]: r for r in records.collect()}
    assert rows[0]["f_Age"] == [22] and rows[2]["f_Age"] == [30, 31] and rows[1]["f_Site"] == ["a", "b"]
    assert rows[1]["f_Seen"] == [] and rows[3]["f_Seen"] == [] and rows[2]["f_Site"] == []
    assert rows[0]["f_Phone"] == [5550100] and rows[0]["f_Pics"] == ["x.jpg", "y.jpg", "z.jpg"]
    out = str(tmp_path / "out.csv")
    annotated.write_annotated(records, features, out)
    again, spec = annotated.read_annotated(spark, out, str(tmp_path / "out_header.csv"))
    assert spec == features
    assert sorted(map(str, again.collect())) == sorted(map(str, records.collect()))
    assert annotated.read_annotated(spark, out, str(tmp_path / "out_header.csv"), max_records=2)[0].count() == 2
    (tmp_path / "other.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        annotated.read_annotated(spark, str(tmp_path / "other.csv"), str(tmp_path / "out_header.csv"))


def test_label_and_text_files(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("5\n5\n7\n")
    assert partition(annotated.read_labels(spark, str(tmp_path / "labels.csv"))) == {frozenset({0, 1}), frozenset({2})}
    (tmp_path / "text").write_text("A b  a\nc\nD d\n")
    wanted = spark.createDataFrame([(0,), (2,)], "record_id long")
    got = {r["doc_id"]: r["tokens"] for r in annotated.read_corpus(spark, str(tmp_path / "text"), wanted).collect()}
    assert got == {0: ["a", "b"], 2: ["d"]}
    (tmp_path / "triples").write_text("ad,text,cluster\n3,9,1\n4,8,1\n")
    assert annotated.read_cluster_triples(spark, str(tmp_path / "triples")).count() == 2
    (tmp_path / "a.arff").write_text("% c\n@relation r\n@attribute name string\n@attribute class integer\n@data\n\"x, y\", 1\n\"z\",2\n")
    assert [tuple(r) for r in annotated.read_arff(spark, str(tmp_path / "a.arff")).orderBy("record_id").collect()] == [("x, y", "1", 0), ("z", "2", 1)]
    (tmp_path / "l").write_text("1,2\n3,4\n")
    (tmp_path / "r").write_text("5,6,7\n")
    assert annotated.join_feature_files(spark, str(tmp_path / "l"), str(tmp_path / "r"), 2).collect()[0]["value"] == "1,2,5,6"


def test_catalogues(spark):
    a = spark.createDataFrame([("1", "n,1", "d", "$1,000.5"), ("2", "m", "d", None)], "id string, name string, description string, price string")
    b = spark.createDataFrame([("9", "n1", "d", "3")], a.schema)
    records, labels = annotated.merge_catalogues(a, b, spark.createDataFrame([("1", "9")], "left_id string, right_id string"))
    assert records.count() == 3 and {len(x) for x in partition(labels)} == {1, 2}
    assert 1000.5 in {r["price"] for r in records.collect()}
    with pytest.raises(ValueError):
        annotated.merge_catalogues(a.union(a), b, spark.createDataFrame([], "left_id string, right_id string"))


def test_blocks(spark, loaded):
    records, features = loaded
    blocks = blocking.generate_blocks(records, features)
    strong = {}
    for r in blocks.where("kind = 'strong'").collect():
        strong.setdefault(r["block_key"], set()).add(r["record_id"])
    assert strong == {"Phone_5550200": {1, 3}, "Owner_3": {2}, "Phone_5550100": {0}, "Owner_1": {0, 3}, "Owner_2": {1}}
    assert not blocks.where("block_key like 'Age%'").count()  # only the exact word blocks
    done = blocking.blocking_scheme(records, features, 1)
    assert {r["record_id"] for r in done.collect()} == {0, 1, 2, 3}
    assert done.where("block_key = 'singular_ad_3'").count() == 1
    single = blocking.blocking_scheme(records, features, 1, single_block=True)
    assert {(r["kind"], r["block_key"]) for r in single.collect()} == {("weak", "All")} and single.count() == 4
    assert blocking.number_of_blocks(single).first()[0] == 1
    assert {(r["id_a"], r["id_b"]) for r in blocking.candidate_pairs(blocks).collect()} == {(0, 1), (0, 2), (0, 3), (1, 3)}


SETS = [
    (sim.number_matches, [1, 2, 3], [1, 2, 3], 3), (sim.number_matches, [1, 2, 3], [3, 4, 5], 1), (sim.number_matches, [], [1], None),
    (sim.numerical_difference, [1, 2, 3], [1, 2, 3], 0), (sim.numerical_difference, [1, 2, 3], [4, 5], 1), (sim.numerical_difference, [1], [], None),
    (sim.binary_match, [1, 2, 3], [3, 4], True), (sim.binary_match, [1, 2, 3], [5], False), (sim.binary_match, None, [5], None), (sim.jaccard, [1, 2, 3], [3, 4, 5], 0.2),
]


@pytest.mark.parametrize("f,a,b,want", SETS)
def test_sets(spark, f, a, b, want):
    row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(f(F.col("a"), F.col("b"))).first()[0]
    assert row == want


def test_text_and_dates(spark):
    rows = [(["Matthew"], ["Matt"], 3), (["abcd", "efgh", "ijkl"], ["abbb", "egfe", "i"], 2), (["a"], ["a"], 0), (["a"], [], None)]
    for a, b, want in rows:
        assert spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(sim.levenshtein(F.col("a"), F.col("b"))).first()[0] == want
    d = spark.sql("select array(timestamp_ntz'2020-05-01 00:00:00') a, array(timestamp_ntz'2020-05-02 00:00:01') b")
    both = d.select(sim.date_difference(F.col("a"), F.col("b")), sim.date_difference(F.col("b"), F.col("a")), sim.date_difference_total(F.col("a"), F.col("b"))).first()
    assert tuple(both) == (86399, 1, 86401)


def test_pair_features(spark, loaded):
    records, features = loaded
    ids = spark.createDataFrame([(0, 0), (0, 3), (1, 3), (0, 1), (0, 2), (1, 2), (2, 3)], "id_a long, id_b long")
    got = {(r["id_a"], r["id_b"]): r for r in pairs.weak_features(ids, records, features).collect()}
    assert [k for k, r in got.items() if r["strong"]] == [k for k in got if k in {(0, 0), (0, 3), (1, 3)}]
    own = got[0, 0]
    assert own["x_Site"] == 0 and own["x_Seen"] == 0 and own["x_Age"] == 0 and math.isclose(own["x_Pics"], math.exp(-3))
    assert got[0, 1]["x_Age"] is None and got[1, 2]["strong"] is False
    table = spark.createDataFrame([(1.0, None, 4.0, None), (None, 4.0, 4.0, None), (1.0, 4.0, None, None)], "a double, b double, c double, d double")
    means = pairs.column_means(table, ["a", "b", "c", "d"])
    assert means == {"a": 1.0, "b": 4.0, "c": 4.0, "d": 0.0}
    assert pairs.impute(table, means).where("a is null or b is null or d is null").count() == 0
    with pytest.raises(ValueError):
        Feature("x", "string", "strong", "", "levenshtein").check()


def test_seed(spark, loaded):
    records, features = loaded
    labels = clustering.strong_cluster(records, features)
    got = pairs.pair_seed(records, labels, features, 0.5).collect()
    assert {(r["id_a"], r["id_b"]) for r in got if r["y"]} <= {(0, 3), (1, 3)} and got
    assert all((2 in (r["id_a"], r["id_b"])) == (r["y"] == 0) for r in got)
    assert pairs.seed_counts(3, 3, 0.5) == (3, 3) and pairs.seed_counts(10, 90, None) == (10, 90) and pairs.seed_counts(10, 10, 0.5, 5) == (5, 5)
    with pytest.raises(ValueError):
        pairs.seed_counts(0, 5, 0.5)
    known = spark.createDataFrame([(1, 0, 7.0), (3, 0, 2.0)], "id_a long, id_b long, x double")
    merged = pairs.merge_precomputed(spark.createDataFrame([(0, 3)], "id_a long, id_b long"), records, known)
    assert merged.first()["x"] == 2.0


def test_clusters(spark, loaded):
    records, features = loaded
    assert partition(clustering.strong_cluster(records, features)) == {frozenset({0, 1, 3}), frozenset({2})}
    groups = spark.createDataFrame([(0, 0), (2, 0), (1, 1), (3, 1), (9, 9)], "record_id long, cluster_id long")
    merged = clustering.merge_by(records, groups, features)
    assert sorted(r["members"] for r in merged.collect()) == [[0, 2], [1, 3]]
    assert merged.where("record_id = 0").first()["f_Age"] == [22, 30, 31]
    assert clustering.merge_by(records, groups.where("cluster_id = 0"), features).count() == 3
    doubled = records.withColumn("members", F.when(F.col("record_id") == 0, F.array(F.lit(0), F.lit(2)).cast("array<bigint>")).otherwise(F.col("members")))
    assert partition(clustering.labels_of(clustering.merge_duplicated(doubled, features))) == {frozenset({0, 2}), frozenset({1}), frozenset({3})}


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000), (2001, 2000), (2000, 2002), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1000] == 1000 and got[2001] == got[2002] == got[2000] == 2000
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


CELLS = [(0, 0, 5), (0, 1, 1), (1, 0, 1), (1, 1, 4), (1, 2, 1), (2, 0, 2), (2, 2, 3)]


@pytest.fixture(scope="module")
def labelings(spark):
    rows, k = [], 0
    for t, p, n in CELLS:
        for _ in range(n):
            rows.append((k, t, p))
            k += 1
    df = spark.createDataFrame(rows, "record_id long, t long, p long").cache()
    return df.select("record_id", F.col("t").alias("cluster_id")), df.select("record_id", F.col("p").alias("cluster_id"))


def test_metrics(spark, labelings):
    true, pred = labelings
    got = metrics.report(true, pred).first().asDict()
    want = {
        "pairwise_precision": 20 / 44, "pairwise_recall": 20 / 40, "pairwise_f1": 10 / 21, "intersection": 20, "true_pairs": 40, "cluster_f1": 0, "aap": 149 / 255, "acp": 193 / 340,
        "closest_precision": (4 / 7 + 5 / 9 + 3 / 6) / 3, "closest_recall": (4 / 7 + 5 / 9 + 3 / 6) / 3, "purity": 12 / 17, "k": math.sqrt(149 / 255 * 193 / 340),
    }
    for k, v in want.items():
        assert math.isclose(got[k], v, abs_tol=1e-9), k
    cells = metrics.cells(true, pred)
    single = true.withColumn("cluster_id", F.col("record_id"))
    split = metrics.merge_distance(cells, metrics.product, metrics.nothing).first()["distance"]
    alone = metrics.merge_distance(metrics.cells(single, pred), metrics.product, metrics.nothing).first()["distance"]
    assert math.isclose(1 - split / alone, 20 / 44)
    cost = metrics.entropy_cost(17.0)
    assert math.isclose(metrics.merge_distance(cells, cost, cost).first()["distance"], got["variation"], abs_tol=1e-9)
    assert {(r["size"], r["occurrences"]) for r in metrics.entity_sizes(true).collect()} == {(5, 1), (6, 2)}
    assert {(r["size"], r["occurrences"]) for r in metrics.entity_sizes(pred).collect()} == {(4, 1), (5, 1), (8, 1)}
    same = metrics.report(true, true).first()
    assert same["pairwise_f1"] == 1 and same["cluster_f1"] == 1 and math.isclose(same["v_measure"], 1)
    renamed = pred.withColumn("cluster_id", F.col("cluster_id") * 7 + 100)
    assert list(metrics.report(true, renamed).first()) == pytest.approx(list(metrics.report(true, pred).first()))
    none = metrics.pairwise(metrics.cells(single, single)).first()
    assert (none["precision"], none["recall"], none["f1"]) == (1.0, 0.0, 0.0)
    with pytest.raises(KeyError):
        metrics.cells(true, pred.where("record_id > 3"), check=True)


def test_curves(spark):
    rows = [(0.9, 1), (0.8, 1), (0.8, 0), (0.3, 0), (0.2, 1)]
    scored = spark.createDataFrame(rows, "score double, label int")
    curve = roc.roc_curve(scored)
    got = {(r["prob"], r["end"]): r for r in curve.collect()}
    assert got[0.8, False]["tp"] == 2 and got[0.8, False]["fp"] == 1 and got[1.0, True]["precision"] == 1
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert math.isclose(roc.auc(scored).first()[0], want)
    assert math.isclose(roc.recall_at(curve, 0.5).first()["recall"], 2 / 3) and roc.recall_at(curve, 1.5).first()["recall"] == 0 and roc.recall_at(curve, -1.0).first()["recall"] == 1
    assert math.isclose(roc.precision_at(curve, 0.5).first()["precision"], 2 / 4) and math.isclose(roc.precision_at(curve, 0.0).first()["precision"], 3 / 5)
    one = spark.range(1).select(F.lit(0.8).alias("precision"))
    pairs_ = spark.createDataFrame([(True,), (False,)], "direct boolean")
    assert math.isclose(roc.precision_bound(pairs_, one, 0.5, 0.5).first()[0], 0.4)
    assert roc.precision_bound(pairs_.limit(0), one, 0.5, 0.5).first()[0] == 1
    assert math.isclose(roc.f1_bound(one, one).first()[0], 0.8)


def test_minhash(spark):
    assert [lsh.rows_per_band(100, t) for t in (0.5, 0.7, 0.9, 1.0)] == [4, 7, 17, 100]
    assert [len(lsh.bands(100, t)) for t in (0.5, 0.7, 0.9, 1.0)] == [25, 15, 6, 1] and lsh.rows_per_band(100, 0.0) == 1
    base = [f"w{i}" for i in range(60)]
    docs = [(0, base), (1, base), (2, base[:58] + ["x"]), (3, [f"z{i}" for i in range(60)]), (4, [])]
    sigs = lsh.signatures(spark.createDataFrame(docs, "doc_id long, tokens array<string>")).cache()
    assert sigs.count() == 4
    assert partition(lsh.minhash_clusters(sigs, 0.7)) == {frozenset({0, 1, 2}), frozenset({3})}
    plain = {i: [min((int(hashlib.sha1(t.encode()).hexdigest()[:7], 16) * a + b) % lsh.PRIME for t in tokens) for a, b in lsh.family()] for i, tokens in docs if tokens}
    assert {r["doc_id"]: r["signature"] for r in sigs.collect()} == plain
    swept = lsh.sweep(spark.createDataFrame(docs, "doc_id long, tokens array<string>"), [0.5, 0.7, 1.0]).cache()
    for t in (0.5, 0.7, 1.0):
        assert partition(swept.where(F.col("threshold") == t)) == partition(lsh.minhash_clusters(sigs, t))
    summary = {r["cluster_id"]: (r["size"], r["edges"]) for r in lsh.cluster_summary(lsh.minhash_clusters(sigs, 0.7), sigs, 0.7).collect()}
    assert summary == {0: (3, 3), 3: (1, 0)}


def test_samples(spark):
    records, labels = sampling.synthetic(spark, 10, 10, 3)
    taken, ty, rest, ry = sampling.sample_labelled(records, labels, 30)
    assert (taken.count(), ty.count(), rest.count(), ry.count()) == (30, 30, 70, 70)
    assert records.groupBy("f_Name_0").count().where("count = 10").count() == 10
    more, _ = sampling.add_entities(records, labels, 2, 2)
    assert more.select("record_id").distinct().count() == 104
    moved = sampling.corrupt(records, 0.5, most=50).join(records.withColumnRenamed("f_Name_0", "old"), "record_id")
    assert moved.where("old <> f_Name_0").count() == 50
    got = sampling.sample_clusters(labels, 50)
    assert got.groupBy("cluster_id").count().where("count <> 10").count() == 0 and got.count() >= 50
    text = sampling.corrupted_tokens(spark, 100, 10, 0.3).select(F.explode("tokens").alias("t"))
    assert 0.25 < text.where("t like '%corrupt'").count() / 10_000 < 0.35


def test_matching(spark):
    spec = sampling.synthetic_features(3)
    records, labels = sampling.synthetic(spark, 20, 5, 3)
    records = sampling.corrupt(records, 0.001).cache()
    seed = pairs.pair_seed(records, labels, spec, 0.5, 100, direct=False).cache()
    match = matching.LogisticMatch(records, labels, seed, spec)
    assert all(w <= 1e-9 for w in match.model.coefficients)
    curve = match.test(records, labels, seed)
    assert match.recall(curve).first()["recall"] > 0.9 and match.precision(curve).first()["precision"] > 0.9
    blocks = blocking.blocking_scheme(records, spec, single_block=True)
    found = resolve.weak_components(records, match, blocks)
    assert metrics.report(labels, found).first()["pairwise_recall"] > 0.9
    with pytest.raises(ValueError):
        resolve.match_and_merge(records.withColumn("block", F.lit("b")), matching.RuleMatch(spec, F.lit(0.0)), spec)


def test_match_and_merge(spark):
    spec = [Feature("word", "string", "weak", "", "number_matches"), Feature("size", "int", "weak", "", "numerical_difference")]
    rows = [(0, ["a"], [1]), (1, ["a", "b"], []), (2, ["b"], [9]), (3, ["c"], [1]), (4, [], [])]
    records = spark.createDataFrame(rows, "record_id long, f_word array<string>, f_size array<long>").withColumn("members", F.array("record_id"))
    rule = matching.RuleMatch(spec, F.when(F.col("x_word") < 1, 1.0).otherwise(0.0), 1.0, icar=True)
    blocks = blocking.blocking_scheme(records, spec, single_block=True)
    entities, labels = resolve.resolve(records, rule, blocks, spec)
    assert partition(labels) == {frozenset({0, 1, 2}), frozenset({3}), frozenset({4})}
    assert entities.where("record_id = 0").first()["f_size"] == [1, 9]


def test_merging_decides(spark):
    """Records that match only once others are merged: components of matches don't join them, match-and-merge does."""
    features = [Feature("w", "string", "weak", "block", "number_matches")]
    rows = [(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["d", "e"]), (4, ["c", "d", "e"]), (5, ["b", "c", "x"]), (6, ["y", "z"])]
    rows += [(7, ["p", "q"]), (8, ["p", "q", "r"]), (9, ["q", "s", "t"]), (10, ["r", "s", "t"])]
    records = spark.createDataFrame(rows, "record_id long, f_w array<string>").withColumn("members", F.array("record_id"))
    rule = matching.RuleMatch(features, F.when(F.col("x_w") < math.exp(-1.5), 1.0).otherwise(0.0), 1.0, icar=True)
    blocks = blocking.blocking_scheme(records, features, single_block=True)
    apart = partition(resolve.weak_components(records, rule, blocks))
    entities, labels = resolve.resolve(records, rule, blocks, features)
    whole = partition(labels)

    def merged():
        """One by one, as long as any two share two words."""
        left = [(frozenset({i}), frozenset(w)) for i, w in rows]
        while hit := next(((x, y) for x in left for y in left if x != y and len(x[1] & y[1]) >= 2), None):
            left = [v for v in left if v not in hit] + [(hit[0][0] | hit[1][0], hit[0][1] | hit[1][1])]
        return {m for m, _ in left}

    assert whole == merged() and whole != apart and len(whole) < len(apart)
    assert {tuple(r["members"]) for r in entities.collect()} == {tuple(sorted(m)) for m in whole}


def test_whole_pipeline(spark, sf):
    from kindred.plans import linkage_queries as lq
    from kindred.plans.experiment import run_pipeline

    records = lq.parts(spark, sf).where("record_id <= 300")
    entities, labels, report = run_pipeline(records.where("record_id % 2 = 0"), records.where("record_id % 2 = 1"), lq.PART)
    assert labels.count() == 150 and entities.select(F.explode("members")).distinct().count() == 150
    row = report.first()
    assert report.count() == 1 and all(v is None or v >= 0 for k, v in row.asDict().items() if "pairwise" in k)


def test_sinks_and_command_line(spark, tmp_path):
    from kindred.plans import near_duplicates
    from kindred.plans.experiment import SWEEP_COLUMNS, synthetic_experiment, write_sweep

    text = tmp_path / "docs.txt"
    lines = [" ".join(f"w{k}_{i}" for i in range(40)) for k in (0, 0, 1, 1, 2)]
    text.write_text("\n".join(lines) + "\n")
    (tmp_path / "labels.txt").write_text("0\n0\n1\n1\n2\n")
    near_duplicates.main([str(text), str(tmp_path / "out"), "--low", "0.6", "--high", "0.8", "--steps", "2", "--labels", str(tmp_path / "labels.txt")], spark)
    got = spark.read.csv(str(tmp_path / "out/summary/threshold=0.8"), header=True, inferSchema=True)
    assert sorted((r["cluster"], r["size"], r["edges"]) for r in got.collect()) == [(0, 2, 1), (2, 2, 1), (4, 1, 0)]
    assert spark.read.csv(str(tmp_path / "out/clusters"), header=True).count() == 10
    assert float(spark.read.csv(str(tmp_path / "out/match_auc"), header=True).first()["auc"]) == 1.0
    scored = spark.createDataFrame([(0.25, 1), (0.75, 0)], "score double, label int")
    roc.write_labels(scored, str(tmp_path / "labels"))
    again = spark.read.csv(str(tmp_path / "labels"), header=True, inferSchema=True)
    assert again.columns == ["label", "probability"] and {tuple(r) for r in again.collect()} == {(1, 0.25), (0, 0.75)}
    write_sweep(synthetic_experiment(spark, 12, 5, 3, thresholds=[0.3, 0.7]), str(tmp_path / "sweep"))
    swept = spark.read.csv(str(tmp_path / "sweep"), header=True, inferSchema=True)
    assert swept.columns == list(SWEEP_COLUMNS.values()) and len(swept.columns) == 13
    assert all(0 <= r["precision_bound"] <= 1 and r["direct_matches"] <= r["pairs"] for r in swept.collect())


def test_stream(spark, loaded, tmp_path):
    from kindred.streaming.blocks import resolve_batches

    records, features = loaded
    records.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(records.schema).parquet(str(tmp_path / "in"))
    rule = matching.RuleMatch([f for f in features if f.strength == "weak"], F.when(F.col("x_Site") == 0, 1.0).otherwise(0.0), 1.0)
    run = resolve_batches(stream, records.limit(0), rule, features, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert partition(found) == {frozenset({0, 1, 3}), frozenset({2})}


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["record_id", "cluster_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_seed_of_huge_clusters(spark):
    ids = spark.range(0, 300_000, 1, 4)
    records = ids.select(F.col("id").alias("record_id"), F.array("id").alias("members"), F.array((F.col("id") % 3).cast("string")).alias("f_s"))
    labels = ids.select(F.col("id").alias("record_id"), F.least(F.floor(F.col("id") / 290_000), F.lit(1)).alias("cluster_id"))
    spec = [Feature("s", "string", "strong", "block", "binary_match")]
    for direct in (False, True):  # 4e10 pairs
        got = pairs.pair_seed(records, labels, spec, 0.5, 500, direct=direct).collect()
        assert len({(r["id_a"], r["id_b"]) for r in got}) == len(got) == 1000 and sum(r["y"] for r in got) == 500
        for r in got:
            assert r["id_a"] < r["id_b"] and r["y"] == int((r["id_a"] >= 290_000) == (r["id_b"] >= 290_000))
            assert not (direct and r["y"]) or r["id_a"] % 3 == r["id_b"] % 3


def test_seed_counts_and_draws(spark, monkeypatch):
    rows = [(i, [i], [i % 7, i % 5][: i % 3], ["x"] if i % 4 == 0 else []) for i in range(60)]
    records = spark.createDataFrame(rows, "record_id long, members array<long>, f_n array<bigint>, f_t array<string>")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "record_id long, cluster_id long")
    spec = [Feature("n", "int", "strong", "block", "number_matches"), Feature("t", "string", "strong", "block", "binary_match")]

    def plain(unknown):
        out = set()
        for a, _, n, t in rows:
            for b, _, m, u in rows:
                if a < b and a % 2 == b % 2:
                    known = [set(x) & set(y) for x, y in ((n, m), (t, u)) if x and y]
                    if any(known) or (unknown and not known):
                        out.add((a, b))
        return out

    for unknown in (True, False):
        want = plain(unknown)
        for listed in (10**6, 1):
            monkeypatch.setattr(pairs, "LISTED", listed)
            count, draw = pairs._positives(labels, records, spec, True, unknown, pairs.Scratch(spark, "test"))
            assert count == len(want)
            few = [(r["id_a"], r["id_b"]) for r in draw(len(want) // 9, 0).collect()]
            assert len(few) == len(set(few)) >= len(want) // 9 and set(few) <= want
            assert {(r["id_a"], r["id_b"]) for r in draw(len(want), 0).collect()} == want


def test_cluster_pairs_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(groups, "TASK_IDS", 1_000_000)
    labels = spark.range(6000).select(F.col("id").alias("record_id"), F.when(F.col("id") < 5000, 0).otherwise(F.col("id")).alias("cluster_id"))
    got = pairs.cluster_pairs(labels)
    assert got.distinct().count() == got.count() == 5000 * 4999 // 2
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < got.count() / 2  # one large cluster isn't one task's work
    assert pairs.cluster_pairs(labels.where("false")).count() == 0


def test_groups_are_their_records(spark):
    rows = [(i, ["w" + str(i % 3), "v" + str(i % 4)], [i % 6, i % 10]) for i in range(90)]
    records = spark.createDataFrame(rows, "record_id long, f_w array<string>, f_k array<bigint>")
    spec = [Feature("w", "string", "weak", "", "number_matches"), Feature("k", "int", "strong", "block", "binary_match")]
    blocks = blocking.generate_blocks(records, spec, ("strong",))
    candidates = {(r["id_a"], r["id_b"]) for r in blocking.candidate_pairs(blocks).collect()}
    assert candidates == {(a, b) for a, _, m in rows for b, _, n in rows if a < b and set(m) & set(n)}
    for expression, limit in ((F.col("x_w"), 0.9), (F.when(F.col("id_a") % 2 == 0, F.col("x_w")), 0.9), (F.when(F.col("strong"), 1 - F.col("x_w")), 0.5)):
        rule = matching.RuleMatch(spec, expression, limit)
        want = sorted(map(tuple, rule.score(blocking.candidate_pairs(blocks), records).collect()), key=repr)
        assert sorted(map(tuple, rule.score_blocks(blocks, records).collect()), key=repr) == want
        edges = spark.createDataFrame([(a, b) for a, b, _, m in want if m], "src long, dst long")
        whole = clustering.with_singletons(connected_components(edges), records)
        assert partition(resolve.weak_components(records, rule, blocks)) == partition(whole)
    met = groups.meet(groups.sliced(groups.block_groups(blocks, records, ["f_w"]), pairs.Scratch(spark, "test")))
    assert groups.first_block(met).agg(F.sum(groups.pair_count())).first()[0] == len(candidates)
    alike = records.withColumn("f_w", F.array(F.lit("w"))).withColumn("f_k", F.array(F.lit(1).cast("bigint")))
    assert groups.block_groups(blocking.generate_blocks(alike, spec, ("strong",)), alike, ["f_w"]).count() == 1


def test_components_of_hubs(spark, monkeypatch):
    from kindred.operators import components

    monkeypatch.setattr(components, "HOT", 20)
    rows = [(0, i) for i in range(1, 60)] + [(i, 500) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 230)] + [(7, 200), (900, 901)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    assert [r[0] for r in components._hot(edges, "dst", len(rows)).collect()] == [500] and components._hot(edges, "src", 20) is None
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    want = {i: 0 for i in [*range(60), *range(200, 231)]} | {i: 100 for i in [*range(100, 160), 500]} | {900: 900, 901: 900}
    assert got == want
