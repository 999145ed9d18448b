"""JPEG media columns, token-ID output and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from keyline.llm import jpeg, queries, tokens
from keyline.llm.storage import setting

# --- JPEG --------------------------------------------------------------------------------


def pack(texts):
    data, starts, notes = b"", [0], []
    for t in texts:
        size = max(-(-len(t) // 64), 1) * 64
        data += t + bytes(size - len(t))
        starts.append(starts[-1] + size)
        notes.append(b"%d,%d" % (len(t), size))
    return jpeg.encode_payloads(np.frombuffer(data, np.uint8), np.array(starts), notes)


def test_payload_round_trip():
    rng = random.Random(3)
    texts = [b"", b"a", bytes(range(256)) * 3, b"\xff" * 1000, b"\x00" * 130, "é😀".encode() * 77, bytes(rng.randrange(256) for _ in range(70_001))]
    texts += [bytes(rng.randrange(256) for _ in range(rng.randrange(600))) for _ in range(60)]
    files = pack(texts)
    for t, f, row in zip(texts, files, jpeg.read_media(files), strict=True):
        assert row["error"] == "" and f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"
        size, payload = jpeg.payload_of(row)
        assert size == len(t) and payload[:size] == t and not any(payload[size:]) and len(payload) % 64 == 0
        assert row["width"] % 8 == 0 and row["thumb"].size * 64 >= len(payload)


class Bits:
    """A slow, plain writer of Huffman-coded blocks, to make files unlike the encoder's."""

    def __init__(self):
        self.bits = ""

    def value(self, codes, run, v):
        size = abs(v).bit_length()
        code, n = codes[run << 4 | size]
        self.bits += format(code, f"0{n}b")
        if size:
            self.bits += format(v if v > 0 else v + (1 << size) - 1, f"0{size}b")

    def flush(self):
        self.bits += "1" * (-len(self.bits) % 8)
        raw = bytes(int(self.bits[i : i + 8], 2) for i in range(0, len(self.bits), 8))
        self.bits = ""
        return raw.replace(b"\xff", b"\xff\x00")


def colour_file(width, height, sampling, restart, rng):
    """A three-component file with runs, ZRL and EOB; its coefficients in scan order."""
    lengths_dc = {s: 4 for s in range(12)}
    symbols = [r << 4 | s for r in range(16) for s in range(1, 6)] + [0, 0xF0]
    lengths_ac = {s: 7 for s in symbols}
    tables, dht = [], b""
    for kind, lengths in ((0, lengths_dc), (16, lengths_ac)):
        counts, order, codes = jpeg.canonical_codes(lengths)
        dht += b"\xff\xc4" + (19 + len(order)).to_bytes(2, "big") + bytes([kind]) + counts + order
        tables.append({s: (codes[s], lengths[s]) for s in order})
    h, v = sampling
    units = -(-width // (8 * h)) * -(-height // (8 * v))
    mcu = [0] * (h * v) + [1, 2]
    coefficients, scan, bits, pred = [], b"", Bits(), [0, 0, 0]
    for u in range(units):
        if restart and u and u % restart == 0:
            scan += bits.flush() + bytes([0xFF, 0xD0 + (u // restart - 1) % 8])
            pred = [0, 0, 0]
        for c in mcu:
            block = [0] * 64
            block[0] = rng.randrange(-200, 200)
            for _ in range(rng.randrange(4)):
                block[rng.randrange(1, 64)] = rng.choice([-9, 3, 1, 30, -31])
            coefficients.append((c, block))
            bits.value(tables[0], 0, block[0] - pred[c])
            pred[c] = block[0]
            run = 0
            last = max([i for i in range(1, 64) if block[i]], default=0)
            for i in range(1, last + 1):
                if not block[i]:
                    run += 1
                    continue
                while run > 15:
                    code, n = tables[1][0xF0]
                    bits.bits += format(code, f"0{n}b")
                    run -= 16
                bits.value(tables[1], run, block[i])
                run = 0
            if last < 63:
                code, n = tables[1][0]
                bits.bits += format(code, f"0{n}b")
    scan += bits.flush()
    size = height.to_bytes(2, "big") + width.to_bytes(2, "big")
    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xdb\x00\x43\x00" + bytes([3] * 64)
    head += b"\xff\xc0\x00\x11\x08" + size + bytes([3, 1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0]) + dht
    if restart:
        head += b"\xff\xdd\x00\x04" + restart.to_bytes(2, "big")
    return head + b"\xff\xda\x00\x0c\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00" + scan + b"\xff\xd9", coefficients


@pytest.mark.parametrize(("width", "height", "sampling", "restart"), [(33, 17, (2, 2), 0), (40, 24, (1, 1), 2), (16, 64, (2, 1), 3), (8, 8, (1, 2), 1)])
def test_colour_files(width, height, sampling, restart):
    rng = random.Random(width)
    made = [colour_file(width, height, sampling, restart, rng) for _ in range(3)]
    for (_, coefficients), row in zip(made, jpeg.read_media([f for f, _ in made]), strict=True):
        assert row["error"] == ""
        for c in range(3):
            assert row["coefficients"][c].tolist() == [b for k, b in coefficients if k == c]
        thumb = row["thumb"]
        assert thumb.shape == (-(-height // 8), -(-width // 8))
        h, v = sampling
        across = -(-width // (8 * h))
        luma = [b[0] for k, b in coefficients if k == 0]
        for y in range(thumb.shape[0]):
            for x in range(thumb.shape[1]):
                unit = (y // v) * across + x // h
                dc = luma[unit * h * v + (y % v) * h + x % h]
                assert thumb[y, x] == np.clip(np.rint(dc * 3 / 8 + 128), 0, 255)


def test_bad_files_do_not_harm_good_ones(spark):
    good = pack([b"hello", b"x" * 500])
    progressive = good[0].replace(b"\xff\xc0\x00\x0b", b"\xff\xc2\x00\x0b")
    cut = good[1][:-200]
    rows = [(1, good[0]), (2, b""), (3, None), (4, b"not a jpeg"), (5, progressive), (6, cut), (7, good[1]), (7, good[1]), (8, good[0][:40])]
    df = spark.createDataFrame(rows, "doc_id long, media binary").withColumn("width", F.lit("clash"))
    out = {r["doc_id"]: r for r in jpeg.media_features(df, key="doc_id", media="media").collect()}
    assert out[1]["error"] is None and (out[1]["width"], out[1]["height"]) == (8, 8) and len(out[7]["thumbnail"]) == 8
    assert all(out[i]["error"] and out[i]["width"] is None for i in (2, 3, 4, 5, 6, 8))
    assert jpeg.media_features(df.limit(0), key="doc_id", media="media").collect() == []


def test_media_query(spark, sf):
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op6_media_columns(spark, sf).collect()}
    assert rows.keys() == texts.keys()
    features = {}
    for i, t in texts.items():
        payload = t + bytes(max(-(-len(t) // 64), 1) * 64 - len(t))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(t), len(payload)) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and features.setdefault(t, r["feature"]) == r["feature"]
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r["payload_bytes"] for r in jpeg.unpack_digests(jpeg.pack_texts(empty)).collect()] == [64, 64]


# --- token ids ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


HARD = [
    "a b <|endoftext|>x", "İstanbul ΣΑΣ σ", "é x\x1cy \x85 z", "don't I'LL 'S", " a　b", " lead  double\t\n", "１２ ½ ⅷ", "日本語 テスト", "a<|startoftext|><|endoftext|>b", "ŉ ǅ ß ẞ", "é ́x",
    "the, The THE. the!", "", "\n\n", "a,b. c., ,.", "x" * 5000,
]


def test_words_encode_like_whole_texts(tokenizer):
    enc = tokens.WordEncoder(queries.tokenizer_path())
    assert enc.by_word and enc.pattern is not None
    for _ in range(2):  # the second time from memory
        for t, raw in zip(HARD, enc.encode(HARD), strict=True):
            assert np.frombuffer(raw, "<i4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    slow = tokens.WordEncoder(queries.tokenizer_path())
    slow.by_word = False
    assert slow.encode(HARD) == enc.encode(HARD)


def test_pieces_reach_the_library_thousands_at_a_time():
    """With the ids of whole texts, also where ends of pieces can't be told by the model's suffix."""

    class Counted:
        def __init__(self, model):
            self.model, self.texts = model, 0

        def __getattr__(self, name):
            def call(texts, **options):
                self.texts += len(texts)
                return getattr(self.model, name)(texts, **options)

            return call

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFÀÉßØÿĀıſ"
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 14))) + rng.choice(["", ",", "</w>", "...", "×÷", "'s", "--1"]) for _ in range(9000)]
    texts = [" ".join(words[i : i + 300]) for i in range(0, 9000, 300)] + ["", " ", "</w> a</w>b <"]
    plain = [e.ids for e in tokens.WordEncoder(queries.tokenizer_path()).tokenizer.encode_batch(texts, add_special_tokens=False)]
    for suffix, ends in (("</w>", True), (None, True), ("</w>", False), ("a", True)):
        enc = tokens.WordEncoder(queries.tokenizer_path())
        enc.forget()
        enc.model, enc.suffix, enc.last = Counted(enc.model), suffix, enc.last & ends
        assert [np.frombuffer(b, "<i4").tolist() for b in enc.encode(texts)] == plain
        if suffix == "</w>" and ends:
            assert 0 < enc.model.texts < 10 and len(enc.pieces) > 8000
        else:
            assert enc.model.texts > 8000


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, tmp_path, tokenizer, encoding):
    rng = random.Random(5)
    rows = [(rng.randrange(10**6), rng.choice(HARD), "z") for _ in range(300)] + [(5, None, ""), (5, "b", ""), (5, "a", ""), (5, "a", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(6)
    path = str(tmp_path / "ids")
    tokens.write_token_ids(df, path, queries.tokenizer_path(), end_id=2, encoding=encoding, row_group_bytes=1 << 16, page_bytes=1 << 12)
    back = sorted(tokens.read_token_ids(spark, path).collect(), key=lambda r: (r["part"], r["seq"]))
    assert [r["doc_id"] for r in back] == sorted(r[0] for r in rows)
    # rows with equal keys in the order of the files
    place = {}
    for n, r in enumerate(back):
        place.setdefault((r["doc_id"], tuple(r["ids"])), n)
    want = sorted(rows, key=lambda r: place[r[0], (*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2)])
    pos, index = 0, sorted(map(tuple, tokens.token_index(spark, path).collect()), key=lambda r: r[1])
    for (i, text, _), r, line in zip(want, back, index, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert r["ids"] == ids and line == (i, pos, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        pos += len(ids)
    meta = [pq.ParquetFile(p).metadata for p in Path(path).glob("*.parquet")]
    groups = [m.row_group(g) for m in meta for g in range(m.num_row_groups)]
    column = groups[0].column(groups[0].num_columns - 1)
    assert column.has_offset_index and ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")
    assert tokens.tokenize_to_table(df.limit(0), queries.tokenizer_path(), end_id=2).collect() == []


def test_random_words_encode_like_whole_texts(tokenizer, monkeypatch):
    """Words of letters, signs, digits and Latin letters in every mixture, with a memory that overflows."""
    monkeypatch.setattr(tokens, "CACHE_WORDS", 300)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 200)
    enc, rng = tokens.WordEncoder(queries.tokenizer_path()), random.Random(2)
    signs = "abcXYZéÉßŉſ×÷'’.,!#<|>09_- \t\nİı日"
    for _ in range(40):
        texts = ["".join(rng.choices(signs, k=rng.randrange(0, 60))) for _ in range(30)] + ["y" * rng.randrange(60, 70) + ",", "a, A, a.", ""]
        ids, sizes = enc.encode_column(pa.array([*texts, None]), 2)
        want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts] + [[2]]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(enc.known) <= 300 + 33 * 60


def test_selected_keys_leave_pages_unread(spark, tmp_path):
    rows = [(i, f"text number {i} " * 40) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "ids")
    tokens.write_token_ids(df, path, queries.tokenizer_path(), end_id=2, row_group_bytes=1 << 22, page_rows=100)

    def read(keys):
        out = tokens.read_token_ids(spark, path, keys=keys)
        got = out.collect()
        node = out._jdf.queryExecution().executedPlan()
        while node.children().size():
            node = node.children().apply(0)
        return {r["doc_id"]: r["ids"] for r in got}, node.metrics().apply("numOutputRows").value()

    every, all_rows = read(None)
    some, few_rows = read([17, 2345])
    assert all_rows == 4000 and some == {k: every[k] for k in (17, 2345)} and few_rows < 1000
    assert read([])[0] == {}


def test_token_order_and_hot_keys(spark, tmp_path):
    rows = [(7, f"t {i}") for i in range(600)] + [(i, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "hot")
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        tokens.write_token_ids(df, path, queries.tokenizer_path(), end_id=2)
    back = tokens.read_token_ids(spark, path)
    assert back.filter("doc_id = 7").select("part").distinct().count() > 1
    starts = [(r["start"], r["doc_id"], r["n_tokens"]) for r in tokens.token_index(spark, path).orderBy("start").collect()]
    assert [d for _, d, _ in starts] == sorted(d for d, _ in rows) and all(a + n == b for (a, _, n), (b, _, _) in zip(starts, starts[1:]))
    kept = str(tmp_path / "kept")
    tokens.write_token_ids(df, kept, queries.tokenizer_path(), end_id=2, by_key=False)
    lie = [r["doc_id"] for r in df.collect()]
    assert [r["doc_id"] for r in tokens.token_index(spark, kept).orderBy("start").collect()] == lie
    with pytest.raises(ValueError):
        tokens.write_token_ids(df.withColumnRenamed("doc_id", "part"), kept, queries.tokenizer_path(), end_id=2, key="part")


# --- pipeline ----------------------------------------------------------------------------


def test_pipeline_against_its_parts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(-1, "12 34 !!", "en", "s", 8), (-2, None, "en", "s", 0)], docs.schema)
    kept = docs.unionByName(junk)
    sizes = [kept.count()]
    texts = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf).toPandas(), docs.schema)
        assert kept.columns == docs.columns, name
        sizes.append(kept.count())
        if name == "decontamination":
            texts = kept.count()
    assert sizes[1] == sizes[0] - 2 and sizes[2] < sizes[1] and sizes[3] < sizes[2] and texts == sizes[3]
    assert abs(sizes[4] - sizes[3]) < 6 * sizes[3] ** 0.5
    out = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert len(out) == sizes[4] and sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)
    whole = corpus_pipeline.run(spark, sf).collect()
    line = lambda r: (r["doc_id"], r["n_tokens"], r["ids_crc32"])
    assert sorted(map(line, whole)) == sorted(map(line, out))
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in whole)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    in_order = [r["doc_id"] for r in sorted(whole, key=lambda r: r["start"])]
    assert in_order != sorted(in_order)  # the shuffle's order is kept


def test_registration():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 11)} and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "mix_sources", "token_ids"]


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"op1_ngram_jaccard"}))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    rel, df = db.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    cell = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    got = sorted(tuple(cell(r[n]) for n in names) for r in df.collect())
    order = [rel.columns.index(n) for n in names]
    assert got == sorted(tuple(cell(r[i]) for i in order) for r in rel.fetchall())


def test_native_operators_run_no_python(spark, sf, plan):
    for name in ("op3_chat_format", "op4_pii_surrogates", "op7_license_scan"):
        text = plan(queries.QUERIES[name](spark, sf))
        # names of licences are in the plan as well, so operators are told by theirs
        assert not any(w in text for w in ("EvalPython", "PythonUDF", "MapInArrow", "InPandas", "ArrowEval", "FlatMapGroups")), name
