"""Mixing, pieces, token counts and files, surrogates, fingerprints, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from codelode.llm import fingerprints, mixing, pieces, registry, sentence_pieces, surrogates, token_counts, token_files
from codelode.llm.common import by_size, documents

SF = "/root/testdata/sf0.001"
BPE, PIECES = registry.BYTE_BPE, registry.PIECES
ODD = [
    None, "", " ", "a b" * 3000, "x" * 4000, " \n\n  a \x1c b\x85 c" * 200, "<|endoftext|> hi<|endoftext|>" * 100,
    "日本 語" * 900, "\0 a\0b", "🙂 🙂" * 500, "  lead", "don't 's" * 300, "a\n\nb \n c\t d  e", "a\r\nb", "caf́e   x",
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(n, t) for n, t in enumerate(ODD)], "doc_id long, text string")


def library_ids(text: str | None) -> list[int]:
    return pieces.library(BPE).encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    own = pieces.Encoder(BPE)
    expected = [np.array(library_ids(t), own.kind).tobytes() for t in ODD]
    assert list(own.encode(ODD)) == expected
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    assert list(pieces.Encoder(BPE).encode(ODD, block=10)) == expected


def test_pieces_with_marks_behind_known_ones():
    """A run of marks is one unit, also if the piece without the last mark was learned before."""
    texts = [
        "a foo) what? wait. \"yes\" x) f() what", "a foo). what?! wait.. \"yes\", x): f(); what!", "what? wait. foo)",
        "what?! wait.. foo).", "\nfoo \nfoo, \nfoo,. foo", "a?\nfoo.. a\nfoo, \n. . .. ... 1. 1.. 1,", "foo foo. foo.. foo... foo....",
    ]
    expected = [np.array(library_ids(t), "<u2").tobytes() for t in texts]
    for block in (1, 4 << 20):
        own = pieces.Encoder(BPE)
        assert list(own.encode(texts, block=block)) == expected
        assert list(own.encode(texts, block=block)) == expected


def test_token_counts(spark, odd):
    docs = odd.unionByName(documents(spark, SF).select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    docs = docs.unionByName(odd.filter("doc_id = 3")).unionByName(odd.filter("doc_id = 5").select(F.lit(None).alias("doc_id"), "text"))
    expected = Counter((r.doc_id, len((r.text or "").encode()), len(library_ids(r.text))) for r in docs.collect())
    got = token_counts.token_counts(docs, BPE, chunk=700, overlap=30).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(docs.limit(0), BPE).count() == 0


def test_overlaps_widen_until_they_meet(spark):
    text = "lead " + "ab" * 3000 + " tail"
    table = spark.createDataFrame([("k", text)], "key string, text string")
    assert token_counts.long_counts(table, BPE, 500, 20).first().n_tokens == len(library_ids(text))


def test_segments():
    draw = np.random.default_rng(1)
    for n, kinds in ((0, 1), (1, 1), (5, 3), (1000, 50000), (60000, 50257), (30000, 1)):
        ids = (draw.zipf(1.2, n) % kinds).astype(np.uint32)
        data = token_files.pack(ids, lanes=64, block=9000)
        segment = token_files.Segment(data)
        assert np.array_equal(segment.ids(), ids)
        if len(segment.directory) > 2:  # blocks are independent
            assert np.array_equal(segment.block(2), ids[18000:27000])
    damaged = bytearray(data)
    damaged[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.Segment(bytes(damaged)).ids()
    damaged = bytearray(data)
    damaged[30] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.Segment(bytes(damaged))


def test_token_files(spark, odd, tmp_path):
    docs = odd.unionByName(documents(spark, SF).select((F.col("doc_id") * 7 - 50).alias("doc_id"), "text")).repartition(7)
    token_files.write(docs, BPE, f"{tmp_path}/files", segment=5000)
    got = [tuple(r) for r in token_files.read_documents(spark, f"{tmp_path}/files").orderBy("start").collect()]
    expected, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text is not None, (r.text or "").encode())):
        ids = np.array([*library_ids(r.text), 0], "<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected
    assert spark.read.parquet(f"{tmp_path}/files").count() > 5
    assert token_files.written_and_read(docs.limit(0), BPE).count() == 0


def test_pieces_of_the_bpe_model(spark, odd):
    texts = [t for t in ODD if t is not None] + [r.text for r in documents(spark, SF).collect()]
    draw = random.Random(3)
    for alphabet in ("ab ", "aae  ", " ", "the in", "日本é \n\t", "0123 .", "%&$* -=", "▁ x"):
        texts += ["".join(draw.choice(alphabet) for _ in range(draw.randrange(40))) for _ in range(40)]
    own = sentence_pieces.Model(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = list(own.encode(texts, block=3000))
    assert ids == library.encode(texts, num_threads=1)
    assert all(own.decode(i) == t for i, t in zip(ids, texts, strict=True) if "▁" not in t)


def test_pieces_of_a_unigram_model(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        proto.ParseFromString(file.read())
    draw = random.Random(5)
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        if piece.type == 1:
            piece.score = -8 + draw.random() * len(piece.piece) * 2
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    texts = ["".join(draw.choice("thein sao") for _ in range(60)) for _ in range(100)]
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert list(sentence_pieces.Model(str(path)).encode(texts)) == library.encode(texts, num_threads=1)


def test_pieces_share_prefixes(monkeypatch):
    own = sentence_pieces.Model(PIECES)
    made = []
    entry = sentence_pieces.Model.entry
    monkeypatch.setattr(sentence_pieces.Model, "entry", lambda s, w, e, x: made.append(w[:e]) or entry(s, w, e, x))
    list(own.walk(["▁the", "▁their", "▁them"]))
    assert made == ["▁", "▁t", "▁th", "▁the", "▁thei", "▁their", "▁them"]


def test_piece_columns(spark, odd):
    docs = odd.withColumn("piece_ids", F.lit("mine"))
    back = sentence_pieces.decoded(sentence_pieces.encoded(docs, PIECES), PIECES, "piece_ids_")
    rows = {r.doc_id: r for r in back.collect()}
    assert back.columns == ["doc_id", "text", "piece_ids", "piece_ids_", "n_pieces", "decoded"]
    assert rows[0].decoded is None and rows[1].piece_ids_ == []
    assert all(r.decoded == r.text for r in rows.values())
    twice = docs.unionByName(docs)
    both = sentence_pieces.round_trip(twice, PIECES)
    assert both.columns == back.columns
    assert Counter(map(str, both.collect())) == Counter(str(r) for r in [*rows.values()] * 2)
    assert sentence_pieces.round_trip(docs.limit(0), PIECES).count() == 0


def test_slices_by_size(spark):
    column = pa.array(["ab", None, "", "é" * 9, "c", "d" * 30, None])
    parts = list(by_size(column, 4))
    assert pa.concat_arrays(parts).equals(column) and [len(p) for p in parts] == [3, 1, 1, 1, 1]
    assert [len(p) for p in by_size(column.slice(0, 0), 4)] == [0]
    docs = spark.range(3000).select("id", F.expr("if(id % 7 = 0, null, repeat(concat('word', id, ' '), 300))").alias("text"))
    back = sentence_pieces.round_trip(docs.coalesce(1), PIECES)
    assert back.filter("not (decoded <=> text)").count() == 0 and back.filter("n_pieces > 300").count() == 2571


def test_boundaries_of_pieces():
    """The steps of the two sides tell what merging the whole tells."""
    own = sentence_pieces.Model(PIECES)

    def merged(text: str) -> list[str]:
        parts = list(text)
        while True:
            pairs = [(-own.score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in own.score]
            if not pairs:
                return parts
            at = min(pairs)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    draw = random.Random(11)
    every = sorted(own.score)
    cuts = [(p[:k], p[k:]) for p in draw.sample(every, 3000) for k in range(1, len(p))]
    pairs = cuts + [(draw.choice(every), draw.choice(every)) for _ in range(5000)]
    for left, right in pairs:
        assert own.stays(left, right) == (merged(left + right) == [left, right]), (left, right)


def test_decoding_any_ids():
    own = sentence_pieces.Model(PIECES)
    byte, blank = own.bytes, own.bytes[32]
    lists = [[], None, [byte[0xE3], byte[0x81]], [own.unknown], [blank, blank], [0, 1, 2, 300], [byte[0xC3], byte[0xA9]]]
    assert own.decoded(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [
        None if x is None else own.decode(x) for x in lists
    ]
    plain = pa.array([x for x in lists if x is None or byte[0xE3] not in x and 1 not in x] * 3, pa.list_(pa.int32()))
    assert own.decoded(plain.slice(2, 7)).to_pylist() == [
        None if x is None else own.decode(x) for x in plain.slice(2, 7).to_pylist()
    ]


def test_mixing_by_statement(spark):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    result = database.execute(registry.oracle_sql()["op2_source_mixing"])
    names = [d[0] for d in result.description]
    expected = Counter(tuple(row[names.index(n)] for n in sorted(names)) for row in result.fetchall())
    got = registry.op2_source_mixing(spark, SF)
    assert Counter(tuple(r[n] for n in sorted(got.columns)) for r in got.collect()) == expected


def test_mixture_follows_the_weights(spark):
    rows = spark.range(30000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit(1).alias("copy"),
    )
    mixture = mixing.Mixture({"hot": 0.1, "b": 0.6, "absent": 5.0}, others=0.3, size=2.0)
    got = mixing.mixed(rows, mixture)
    assert got.columns == ["doc_id", "text", "source", "copy", "copy_", "copies", "rate", "place"]
    share = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(share["hot"] - 6000) < 400 and abs(share["b"] - 36000) < 900 and abs(share[None] - 18000) < 700
    assert got.count() == got.select("doc_id", "copy_").distinct().count()
    again = mixing.mixed(rows.repartition(9), mixture)
    assert again.exceptAll(got).count() == 0
    by_place = got.select("place", F.spark_partition_id().alias("p")).groupBy("p").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    bounds = sorted((r.a, r.b) for r in by_place.collect())
    assert all(x[1] <= y[0] for x, y in zip(bounds, bounds[1:], strict=False))


def test_mixing_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None), (None, "", "a"), (1, "x", "a"), (1, "x", "a")], "doc_id long, text string, source string")
    assert mixing.mixed(rows, mixing.Mixture({"a": 1.0}, others=1.0, size=50.0)).count() > 50
    assert mixing.mixed(rows, mixing.Mixture({"a": 0.0}, others=0.0)).count() == 0
    assert mixing.mixed(rows.limit(0), mixing.Mixture({"a": 1.0}, others=1.0)).count() == 0


def test_large_rates(spark):
    table = spark.range(1).select(mixing._cumulative(F.lit(2000.0)).alias("c"))
    values = table.first().c
    assert abs(values[-1] - 1) < 1e-6 and abs(np.searchsorted(values, 0.5) - 2000) <= 1


def test_surrogates(spark):
    texts = [
        "Write to a.b@x.org or A.B@X.ORG, call +1 (988) 555-2485 or 988-555-2485!", "ip 10.0.0.1 and 8.8.8.8.",
        "card 4111111111111111 or 4111-1111-1111-1111, not 4111111111111112", "Mrs. Anna Berg met Mr. Berg; госпожа Ольга Петрова",
        None, "", "nothing 1.2.3 here 256.1.1.1", "8.8.8.8", "8.8.8.8 x@y.de y@x.com",
    ]
    rows = spark.createDataFrame([(n, t, "q") for n, t in enumerate(texts)], "doc_id long, text string, n_replaced string")
    got = surrogates.replaced(rows, "k")
    assert got.columns == ["doc_id", "text", "n_replaced", "n_replaced_"]
    new = {r.doc_id: r for r in got.collect()}
    assert [new[n].n_replaced_ for n in range(9)] == [4, 2, 2, 3, 0, 0, 0, 1, 3]
    assert new[4].text is None and new[5].text == "" and new[6].text == texts[6]
    low, high = re.search(r"(\S+@\S+) or (\S+@\S+),", new[0].text).groups()
    assert low.upper() == high and low != "a.b@x.org"
    phones = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3})-(\d{3}-\d{4})!", new[0].text).groups()
    assert phones[:2] == phones[2:] and phones[:2] != ("988", "555-2485")
    a, b = re.search(r"card (\d+) or ([\d-]+), not 4111111111111112", new[2].text).groups()
    digits = [int(c) for c in a[::-1]]
    assert b.replace("-", "") == a and a != "4111111111111111"
    assert (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0
    woman, man = re.search(r"Mrs\. (\w+ \S+) met Mr\. (\S+);", new[3].text).groups()
    assert woman.split()[1] == man and woman.split()[0] in surrogates.GIVEN["female Latin"]
    assert re.search("госпожа [А-Я][а-я]+ [А-Я]", new[3].text) and "Петрова" not in new[3].text
    assert new[7].text == new[8].text.split()[0] == new[1].text.split()[-1][:-1]
    assert surrogates.replaced(rows.limit(0), "k").count() == 0


def test_surrogates_of_numbers_in_a_row(spark):
    """What stands behind a telephone number is no part of it."""
    phone, ip = "+1 (555) 123-4567", "192.168.10.25"
    texts = [
        f"{phone} {ip} on", f"{phone} 12 items", f"{phone} 2024 budget", f"{phone}-{ip}", f"{phone}, {ip}.",
        f"+49 30 1234 5678 {ip}", f"+44 20 7946 0958 12 items", "+33 1 23 45 67 89 20 on", "+33.1.23.45.67.89.", "+33 1 23.45.67.89 on",
        "+49 30 1234 5678-90", "+420 601-123-456 20", "+49 30 1234 567 9012 34", "+7 495 123-45-67 10", "+1 555 123 4567", "+1-555-123-4567 8.8.8.8",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.m for r in rows.select("doc_id", surrogates.mentions(F.col("text")).alias("m")).collect()}
    assert [found[n] for n in range(len(texts))] == [
        [phone, ip], [phone], [phone], [phone, ip], [phone, ip],
        ["+49 30 1234 5678", ip], ["+44 20 7946 0958"], ["+33 1 23 45 67 89"], ["+33.1.23.45.67.89"], ["+33 1 23.45.67.89"],
        ["+49 30 1234 5678-90"], ["+420 601-123-456"], ["+49 30 1234 567 9012"], ["+7 495 123-45-67"], ["+1 555 123 4567"],
        ["+1-555-123-4567", "8.8.8.8"],
    ]
    new = {r.doc_id: r for r in surrogates.replaced(rows, "k").collect()}
    first = new[1].text.removesuffix(" 12 items")
    assert first != phone and new[0].text.startswith(f"{first} 10.") and new[0].text.endswith(" on") and ip not in new[0].text
    assert new[2].text == f"{first} 2024 budget" and new[0].n_replaced == 2
    assert re.sub(r"\D", "", new[14].text) == re.sub(r"\D", "", first)


def test_surrogates_of_common_forms(spark):
    texts = {
        "+15551234567, +1 (555) 123-4567": ["+15551234567", "+1 (555) 123-4567"],
        "+49 151 23456789, +4915123456789 on": ["+49 151 23456789", "+4915123456789"],
        "+55 11 98765-4321; +4111111111111111; +12345678.5": ["+55 11 98765-4321", "4111111111111111"],
        "Mr. McDonald, Mr. Mcdonald's": ["Mr. McDonald", "Mr. Mcdonald"],
        "Frau Müller-Schmidt": ["Frau Müller-Schmidt"], "Mr. J. Smith, Mr. J.R. Smith": ["Mr. J. Smith", "Mr. J.R. Smith"],
        "Mrs O'Brien met Herr D’Angelo.": ["Mrs O'Brien", "Herr D’Angelo"], "Mr. SMITH": ["Mr. SMITH"],
        "госпожа Анна Римская-Корсакова": ["госпожа Анна Римская-Корсакова"], "Mr. X said": [],
        "Herr Müller東京": ["Herr Müller"],
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.text: r.m for r in rows.select("text", surrogates.mentions(F.col("text")).alias("m")).collect()}
    assert found == texts
    new = {r.doc_id: r.text for r in surrogates.replaced(rows, "k").collect()}
    for n, whole in ((0, r"\+1(\d{10}), \+1 (\(\d{3}\) \d{3}-\d{4})"), (1, r"\+49 (\d{3} \d{8}), \+49(\d{11}) on")):
        a, b = re.fullmatch(whole, new[n]).groups()
        assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    assert not any(w in t for t in new.values() for w in ("Donald", "Schmidt", "Smith", "Brien", "Angelo", "SMITH", "Римская"))
    one, two = re.fullmatch(r"Mr\. (\S+), Mr\. (\S+)'s", new[3]).groups()
    assert one == two and new[9] == "Mr. X said"


def test_surrogates_stay_distinct(spark):
    """A thousand names of few words, and telephone numbers of which none may become another's."""
    names = spark.range(1000).select(F.lit("surname Latin").alias("type"), F.concat(F.lit("n"), "id").alias("canonical"))
    ips = spark.range(500).select(F.lit("ip").alias("type"), F.concat(F.lit("10.1.1."), "id").alias("canonical"))
    got = surrogates.assigned(names.unionByName(ips), "k").collect()
    assert len(got) == 1500 and len({(r.type, r.surrogate) for r in got}) == 1500
    assert not {r.surrogate for r in got} & {r.canonical for r in got}
    again = surrogates.assigned(names.unionByName(ips).repartition(7), "k").collect()
    assert set(again) == set(got)


def test_surrogates_in_documents(spark):
    sf = "/root/testdata/sf0.01"
    pattern = re.compile(r"[\w.]+@[\w.]+\w|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+1 \(\d{3}\) \d{3}-\d{4}", re.I)
    docs = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    new = {r.doc_id: r.text for r in registry.op5_surrogates(spark, sf).collect()}
    found: dict = {}
    for i, text in docs.items():
        old = pattern.findall(text)
        assert pattern.sub("#", text) == pattern.sub("#", new[i]) or re.search(r"\d{16}", text)
        for a, b in zip(old, pattern.findall(new[i]), strict=True):
            found.setdefault(a.lower(), set()).add(b.lower())
    assert len(found) > 20 and all(len(v) == 1 for v in found.values())
    assert len(set.union(*found.values())) == len(found) and not any(a in v for a, v in found.items())


def test_fingerprints(spark):
    docs = documents(spark, SF).select("doc_id", "text").unionByName(
        spark.createDataFrame([(-70, "a b"), (10**12, "c\nd e"), (-5, ""), (10**6, None)], "doc_id long, text string")
    )
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in fingerprints.fingerprinted(docs.repartition(5)).collect()}
    prints: dict = {}
    for k, (i, text) in enumerate(rows):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + rows[(k + 1) % len(rows)][1][:cut]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints.setdefault(text, set()).add(got[i].fingerprint)
        if edited == text:
            assert got[i].fingerprint == got[i].edited_fingerprint and got[i].near_edited == 1
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert all(len(p) == 1 for p in prints.values()) and len(set.union(*prints.values())) == len(prints)
    near = [(r.near_edited, r.near_next) for r in got.values() if r.n_chars > 400]
    assert np.mean([a for a, _ in near]) > 0.6 and np.mean([b for _, b in near]) < 0.1


def test_trees_locate_edits(spark):
    lines = [f"paragraph {n} has its own words" for n in range(40)]
    other = [*lines[:20], "an edited one", *lines[21:30], "one more", *lines[30:]]
    table = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    trees = table.select(fingerprints.tree(F.col("a")).alias("a"), fingerprints.tree(F.col("b")).alias("b"))
    row = trees.select(
        fingerprints.changed_paragraphs(F.col("a"), F.col("b")).alias("gone"),
        fingerprints.changed_paragraphs(F.col("b"), F.col("a")).alias("new"),
        fingerprints.changed_paragraphs(F.col("a"), F.col("a")).alias("same"),
        F.size(F.array_intersect("a.sections", "b.sections")).alias("kept"), F.size("a.sections").alias("all"),
        fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("l"),
        fingerprints.tree_likeness(F.col("a"), F.col("b")).alias("t"),
    ).first()
    assert (row.gone, row.new, row.same) == ([21], [21, 31], []) and 0 < row["kept"] < row["all"]
    assert row.l == row.t and 0.8 < row.l < 1


def test_fingerprints_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, "zz zz"), (4, "same"), (4, "same"), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_chars): r for r in fingerprints.fingerprinted(rows).collect()}
    assert got[None, 5].edited_sha256 == hashlib.sha256(b"zz z").hexdigest()
    one = fingerprints.fingerprinted(rows.filter("doc_id = 5")).first()
    assert (one.n_chars, one.near_edited, one.near_next) == (0, 1.0, 1.0)
    assert fingerprints.fingerprinted(rows.limit(0)).count() == 0


def test_pipeline(spark):
    docs = documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.dtypes == docs.dtypes, name
        docs = after
    rows = corpus_pipeline.run(spark, SF)
    got = rows.collect()
    assert got and all(r.round_trip for r in got)
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    kept = {r.doc_id for r in registry.op1_quality_rules(spark, SF).collect() if r["kept"]}
    assert {r.doc_id for r in got} <= kept
