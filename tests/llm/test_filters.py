"""Quality rules, language identification, near duplicates and repeated passages."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import language, near_duplicates, quality, repeats
from codelode.llm.common import documents
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ROWS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "one", "a b", "a b c a b c a b c", "x" * 5000, "é " * 300, "A\n A\nA\nA \x1c b", "\0", "🙂 ok"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(n, t, None if n % 3 else "en", None, None) for n, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[6], rows[6], (None, "lost id", "en", "s", 1)], ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ROWS)


def test_base_figures(spark, odd):
    docs = documents(spark, SF).unionByName(odd)
    expected = sorted((r.doc_id if r.doc_id is not None else -1, *brute.base_figures(r.text)) for r in docs.collect())
    got = quality.assess(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((r.doc_id if r.doc_id is not None else -1, *(r[n] for n in names)) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and 0 <= r.quality <= 1


def test_rules_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label")
    judged = quality.assess(documents(spark, sf)).join(labels, "doc_id").filter("not base_failed")
    rows = judged.groupBy("label", "kept").count().collect()
    count = {(r.label, r.kept): r["count"] for r in rows}
    assert count.get((0, True), 0) == 0
    assert count.get((1, False), 0) <= 0.01 * count[1, True]


def test_estimated_accuracies():
    draw = np.random.default_rng(7)
    truth = draw.random(20000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    votes = np.where(draw.random((20000, 5)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    votes[draw.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit(patterns, counts)
    assert abs(np.exp(model.log_prior[1]) - 0.7) < 0.03
    assert np.allclose([model.accuracy(k) for k in range(5)], right, atol=0.03)


def test_good_documents_keep_their_columns(spark, odd, empty):
    docs = odd.withColumn("n_words", F.lit("mine")).withColumn("_figure", F.lit(1))
    assert quality.good_documents(docs).columns == docs.columns
    assert quality.good_documents(empty).count() == 0 and quality.assess(empty).count() == 0


def test_languages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in found)
    assert len(found) > 100 and right >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_of_odd_texts(spark, odd, empty):
    found = {r.doc_id: r for r in language.identify(odd).collect()}
    assert found[0].lang_pred == found[1].lang_pred == found[10].lang_pred == "und" and found[0].score == 0
    assert {r.lang_pred for r in found.values()} == {"en", "und"}
    assert found[None].held_out is False
    assert language.identify(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_counts_of_grams_in_runs(monkeypatch):
    text = "The quick brown fox, 12 éclairs."
    whole = np.sort(np.concatenate(list(language.grams(text))))
    monkeypatch.setattr(language, "RUN", 5)
    assert np.array_equal(np.sort(np.concatenate(list(language.grams(text)))), whole)


def test_near_duplicates(spark, odd):
    draw = random.Random(3)
    docs = [(r.doc_id, r.text) for r in documents(spark, SF).select("doc_id", "text").collect()]
    base = [f"w{draw.randrange(400)}" for _ in range(120)]
    for n in range(40):  # a chain of versions, each a little off the one before
        base[draw.randrange(120)] = f"v{n}"
        docs.append((1000 + n, " ".join(base)))
    docs += [(2000 + n, t) for n, t in enumerate(ODD)] + [(2100, "ONE"), (2101, "a  B")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for width in (4, 5):
        got = {r.doc_id: r for r in near_duplicates.components(table, width=width).collect()}
        assert {i: r.component_id for i, r in got.items()} == brute.components(docs, width)
        assert all(r.n_shingles == len(brute.shingle_set(t, width)) for i, t in docs if (r := got[i]))
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = near_duplicates.first_of_each(table.withColumn("component_id", F.lit(1)), width=5)
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert {r.doc_id for r in kept.collect()} == {i for i, c in brute.components(docs, 5).items() if i == c}


def test_different_words_have_different_hashes(spark):
    """Thue-Morse sequences, in which sums of powers cancel modulo powers of two, and exchanged blocks."""
    words = []
    for n in (5, 6, 8, 10, 12):
        one = "".join("ab"[k.bit_count() % 2] for k in range(1 << n))
        words += [one, one.translate(str.maketrans("ab", "ba"))]
    blocks = [c * 32 for c in "abcd"]
    words += ["".join(x) for x in (blocks, blocks[::-1], blocks[1:] + blocks[:1], blocks[:3])] + ["a", "b", "a" * 33]
    data = " ".join(words).encode()
    found, starts = near_duplicates._word_hashes(data)
    assert len(starts) == len(words) == len(set(found.tolist()))
    again, _ = near_duplicates._word_hashes(b"\n xyz " + data)
    assert again[1:].tolist() == found.tolist()
    rows = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert all(r.component_id == r.doc_id and r["kept"] for r in near_duplicates.components(rows).collect())


def test_near_duplicates_without_ids_or_rows(spark, odd, empty):
    rows = near_duplicates.components(odd).collect()
    assert len(rows) == odd.count()
    lost = next(r for r in rows if r.doc_id is None)
    assert lost.kept and lost.component_id is None
    assert near_duplicates.components(empty).count() == 0 and near_duplicates.first_of_each(empty).count() == 0


def test_signatures_tell_the_similarity(spark):
    draw = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        common = draw.integers(0, 1 << 63, int(2000 * share), np.uint64)
        rest = draw.integers(0, 1 << 63, (2, 1000 - len(common) // 2), np.uint64)
        low = np.stack([near_duplicates.minima(np.concatenate([common, r])) for r in rest])
        true = len(common) / (len(common) + 2 * rest.shape[1])
        rows = near_duplicates.packed(low).view(np.int64).tolist()
        table = spark.createDataFrame([tuple(rows)], "a array<long>, b array<long>")
        told = table.select(near_duplicates.estimate(F.col("a"), F.col("b"))).first()[0]
        assert abs(told - true) < 0.12


def test_torn_buckets_get_further_pivots(spark):
    """Links between members of a bucket that its first pivot is not linked with are found too."""
    sets = {1: range(0, 100), 2: range(200, 300), 3: range(202, 302), 4: range(400, 500), 5: range(401, 501)}
    rows = [(i, " ".join(f"t{k}" for k in s)) for i, s in sets.items()]
    table = spark.createDataFrame(rows, "id long, text string")
    signed = table.mapInArrow(near_duplicates._signed(1), near_duplicates._SIGNED)
    search = near_duplicates._Search(table, signed, 1, 0.8)
    members = spark.createDataFrame([(9, i, 1) for i in sets], "bucket long, id long, pivot long")
    search.first_round(members)
    search.further_rounds(members)
    assert {(r.id, r.component) for r in search.components.collect()} == {(3, 2), (5, 4)}


def test_long_chains_are_connected(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(1, 60)] + [(100, 101)], "x long, y long")
    found = {r.id: r.component for r in near_duplicates.connected(links).collect()}
    assert found == {**dict.fromkeys(range(2, 61), 1), 101: 100}


def test_repeats_in_documents(spark):
    docs = documents(spark, SF).select("doc_id", "text")
    got = {r.doc_id: [tuple(r)[1:]] for r in repeats.without_repeats(docs).collect()}
    assert got == brute.without_repeats([tuple(r) for r in docs.collect()], 200)


@pytest.mark.parametrize(("length", "trigger", "run", "together"), [(12, 4, 1 << 20, 4096), (30, 8, 50, 2)])
def test_repeats_in_random_texts(spark, monkeypatch, length, trigger, run, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)  # beyond it windows are shuffled by hash
    draw = random.Random(length)
    base = "".join(draw.choice("ab cé") for _ in range(500))
    rows = []
    for n in range(40):
        parts = (base[(k := draw.randrange(450)) : k + draw.randrange(60)] + draw.choice(["", "x", "a" * 40]) for _ in range(6))
        rows.append((n, "".join(parts)))
    rows += [(3, rows[5][1]), (3, rows[5][1]), (None, "ab" * 40), (77, None), (78, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got: dict = {}
    for r in repeats.without_repeats(table, length=length, trigger=trigger).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert {i: sorted(v) for i, v in got.items()} == brute.without_repeats(rows, length)
    data = (base * 3).encode()
    cut = [sum(int(p[1].sum()) for p in repeats.phrases(data, length, trigger, r)) for r in (run, 10_000)]
    assert cut == [len(data) - length + 1] * 2


def test_repeats_of_nothing(spark, empty):
    assert repeats.without_repeats(empty).count() == 0


def test_language_priors_do_not_depend_on_the_partitioning(spark):
    rows = [("123", "a"), ("??", "b"), (None, "b"), ("abc", "b"), ("xyz abc", "a")] * 4 + [("12", "c")] * 9
    frame = spark.createDataFrame(rows, "text string, lang string")
    one, many = (language.learn(frame.repartition(n)) for n in (1, 12))
    assert one.languages == many.languages == ("a", "b")
    assert one.log_prior.tolist() == many.log_prior.tolist() == [np.log(0.5)] * 2
    assert (one.log_gram == many.log_gram).all()
