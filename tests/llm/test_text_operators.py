"""Language identification, chat formatting, PII, licences, mixing, WARC."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyline.llm import chat, langid, licenses, mixing, pii, queries, warc

# --- language ----------------------------------------------------------------------------

SAMPLES = {"en": "the quick brown fox jumps over the lazy dog and then the other dogs run with them ", "de": "der schnelle braune fuchs springt über den faulen hund und dann laufen die anderen hunde "}


def longest_match_phrases(sample, text):
    """Cross-parsing by plain string search."""
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in sample:
            k += 1
        at += max(k - 1, 1)
        n += 1
    return n


@pytest.mark.parametrize("block", [3, 7, 512])
def test_cross_parsing_equals_plain_search(monkeypatch, block):
    """Also where phrases cross one or many borders of blocks."""
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(1)
    as_text = lambda s: "".join(chr(x + 65) for x in s)
    for _ in range(40):
        samples = {str(i): [rng.randrange(4) for _ in range(rng.randrange(1, 80))] for i in range(3)}
        model = langid.Model.build(samples, "abc")
        texts = [[rng.randrange(5) for _ in range(rng.randrange(0, 90))] for _ in range(4)] + [samples["0"] * 3, [0, 1, 2] * 30]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = langid.count_phrases(np.array([s for t in texts for s in t], np.int32), starts, model)
        assert got.tolist() == [[longest_match_phrases(as_text(samples[k]), as_text(t)) for k in model.languages] for t in texts]


def test_predictions_of_long_texts_equal_plain_search(spark):
    """Whole predictions against cross-parsing by string search, on texts of several blocks."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(SAMPLES[k].split(), k=60)), k) for i, k in enumerate(["en", "de"] * 12)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(labelled)
    samples = {k: "".join(t + " " for _, t in sorted((r["h"], r["text"]) for r in labelled.filter(F.col("lang") == k).select(
        F.struct((F.pmod(F.xxhash64("text"), F.lit(1 << 31))).alias("p"), F.xxhash64("text").alias("x")).alias("h"), "text").collect())) for k in SAMPLES}
    texts = [" ".join(rng.choices(SAMPLES["en"].split() + SAMPLES["de"].split(), k=n)) for n in (3, 200, 900)] + [samples["de"][:2376]]
    out = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in out:
        counts = {k: longest_match_phrases(samples[k], r["text"]) for k in sorted(SAMPLES)}
        best = min(sorted(SAMPLES), key=counts.get)
        assert r["lang_pred"] == best and math.isclose(r["phrase_rate"], counts[best] / len(r["text"]))
        assert math.isclose(r["score"], 1 - counts[best] / max(counts.values()))
    assert {r["doc_id"]: r["phrase_rate"] for r in out}[3] == 1 / 2376


SCRIPTS = {"en": (0x61, 26, 5), "ru": (0x430, 32, 6), "zh": (0x4E00, 1500, 2), "ja": (0x3041, 80, 4), "ko": (0xAC00, 1200, 3)}


def test_many_scripts(spark):
    """Every label with a script of its own, however many letters, is learned and found."""
    rng = random.Random(9)

    def text(k):
        base, letters, size = SCRIPTS[k]
        words = ["".join(chr(base + int(letters * rng.random() ** 2)) for _ in range(rng.randrange(1, 2 * size))) for _ in range(60)]
        return " ".join(words) if k != "zh" else "。".join(words)

    rows = [(i, text(k), k) for i, k in enumerate([*SCRIPTS] * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id < 200"))
    found = langid.predict(df.filter("doc_id >= 200"), model).collect()
    assert model.languages == sorted(SCRIPTS) and len(found) == 200
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.98


def test_prediction_names_in_use(spark):
    rows = spark.createDataFrame([(1, SAMPLES["en"], 7, "old", "x"), (2, None, 8, "old", "y")], "doc_id long, text string, `a.b` int, score string, `Lang_Pred` string")
    model = langid.fit(spark.createDataFrame([(SAMPLES["en"], "en"), (SAMPLES["de"], "de")], "text string, lang string"))
    out = langid.predict(rows, model)
    assert out.columns == ["doc_id", "text", "a.b", "lang_pred", "score", "phrase_rate"]
    assert [(r["a.b"], r["lang_pred"]) for r in out.orderBy("doc_id").collect()] == [(7, "en"), (8, "und")]


def test_language_edge_cases(spark):
    rows = [(i, SAMPLES[k] * 3, k) for i, k in enumerate(["en", "de"] * 6)] + [(20, None, "en"), (21, "x", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [(1, SAMPLES["en"]), (2, SAMPLES["de"].upper()), (3, None), (4, ""), (5, "12 !? 3"), (6, "你好世界你好世界"), (6, "你好世界你好世界"), (7, SAMPLES["en"] * 4000), (8, "\ud800the".encode("utf-8", "ignore").decode())]
    df = spark.createDataFrame([(*t, "junk", 0.5) for t in texts], "doc_id long, text string, lang string, other double")
    out = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert out[6]["phrase_rate"] > 0.8 and out[1]["phrase_rate"] < 0.3 and out[3]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[1]["lang"] == "junk"
    assert langid.predict(df.limit(0), model).collect() == []
    empty = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, empty).collect()} == {"und"}


def test_copies_do_not_change_the_model(spark):
    rng = random.Random(3)
    words = {k: ["".join(rng.choice(k) for _ in range(rng.randrange(2, 8))) for _ in range(50)] for k in ("abcde", "defgh", "ghijk", "klmno", "opqrs", "stuvw")}
    once = [(" ".join(rng.choices(w, k=12)), k) for n, (k, w) in zip((1, 1, 1, 20, 100, 700), words.items(), strict=True) for _ in range(n)]
    group = {k: t for t, k in once}  # one text of each language makes up most rows
    rows = spark.createDataFrame(once, "text string, lang string")
    copies = spark.createDataFrame([(t, k) for k, t in group.items()], "text string, lang string").crossJoin(spark.range(5000)).drop("id")
    plain, heavy = langid.fit(rows), langid.fit(rows.unionByName(copies))
    assert heavy.languages == sorted(words) and heavy.letters == plain.letters
    assert all(np.array_equal(getattr(plain, x), getattr(heavy, x)) for x in ("keys", "goals", "first", "roots"))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = queries.op2_language_id(spark, sf).join(docs, "doc_id").filter("held_out").collect()
    assert len(found) > 100 and sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.98


UNLEARNED = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
}


def test_pipeline_rejects_text_in_no_learned_language(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(1)
    junk = [*UNLEARNED.values(), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(400)), "你好世界你好世界", "你", "12 !?", ""]
    clean = ["a", " A. ", "The.", "Von der", 'Est une èment, éanpavi token = "6cfd1f1f244d4c4c327ecfd8fd9898497c475388" ouletion.']
    added = [(-1 - i, t, None) for i, t in enumerate(junk + clean)]
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(added, docs.schema)), sf)
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {i for i in ids if i < 0} == {-1 - i for i in range(len(junk), len(added))}
    lettered = docs.filter(F.col("text").rlike(r"\p{L}")).select("doc_id").distinct()
    assert ids - {i for i in ids if i < 0} == {r["doc_id"] for r in lettered.collect()}


# --- chat --------------------------------------------------------------------------------


def parts_of(*items):
    keys = ("kind", "text", "ref", "width", "height", "seconds", "pages")
    return [tuple(i.get(k) for k in keys) for i in items]


def test_chat_round_trip_and_attachments(spark):
    hostile = ["\\l \\s <turn> </turn>\n", "<", "\\", "\\\\l<", "</turn>\n<turn>x<body>", "", None, "é😀<"]
    rows = [(1, i, "assistant" if i % 2 else "user<body>", parts_of({"kind": "text", "text": t})) for i, t in enumerate(hostile)]
    media = parts_of(
        {"kind": "text", "text": "see <image:9>"}, {"kind": "image", "ref": "a.jpg", "width": 28, "height": 15}, {"text": "!"}, {"kind": "audio", "ref": "b.wav", "seconds": 2.01},
        {"kind": "document", "ref": "c.pdf", "pages": 3}, {"kind": "image", "ref": None},
    )
    rows += [(2, 1, None, None), (2, 0, "user", media), (3, None, "assistant", parts_of({"kind": "image", "ref": "z"})), (3, None, "assistant", parts_of({"kind": "image", "ref": "z"}))]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>").repartition(3)
    out = chat.format_conversations(df)
    back = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in back.collect()}
    assert [(t["role"], t["content"]) for t in got[1]["turns"]] == [("assistant" if i % 2 else "user<body>", t or "") for i, t in enumerate(hostile)]
    assert got[1]["loss"] == "".join(t or "" for i, t in enumerate(hostile) if i % 2)
    assert got[2]["formatted"].startswith("<turn>user<body>see \\limage:9><image:1>!<audio:2><document:3><image:4></turn>\n<turn><body></turn>\n")
    assert [(a["number"], a["kind"], a["ref"], a["tokens"]) for a in got[2]["attachments"]] == [(1, "image", "a.jpg", 4), (2, "audio", "b.wav", 51), (3, "document", "c.pdf", 768), (4, "image", None, 0)]
    assert got[2]["n_attachment_tokens"] == 823 and [a["number"] for a in got[3]["attachments"]] == [1, 2]
    assert chat.format_conversations(df.limit(0)).collect() == []


# --- PII ---------------------------------------------------------------------------------


def test_surrogates_keep_type_and_coreference(spark):
    text = "und.34@mail7.example.com +1 (743) 555-3824 8.196.197.208 10.0.0.7 Mr. John Smith, Mrs. Smith; Herr Müller 4845168114407329 4532-0151-1283-0366 123-45-6789 token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\""
    keep = "9807915762804490 1.2.3 999.1.1.1 1709000000 version 3.0.1 a@b MIT 2024-01-02 12345 x.y.z"
    rows = [(1, text), (2, f"again und.34@mail7.example.com. {keep}"), (3, None), (4, ""), (5, keep), (2, f"again und.34@mail7.example.com. {keep}")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, value string")
    out = pii.replace_pii(df, secret_key="k").collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 6 and by[3]["text"] is None and by[3]["pii_types"] is None and by[4]["text"] == "" and by[5]["text"] == keep and by[5]["pii_types"] == []
    assert by[1]["pii_types"] == ["email", "phone", "ip", "ip", "person", "person", "person", "card", "card", "ssn", "secret"]
    made = by[1]["text"]
    mail = made.split(" ")[0]
    assert mail != "und.34@mail7.example.com" and re.fullmatch(r"[a-z]{3}\.\d\d@mail\d+\.example\.org", mail) and by[2]["text"] == f"again {mail}. {keep}"
    assert re.search(r"\+1 \([2-9]\d\d\) \d{3}-\d{4} \d+\.\d+\.\d+\.\d+ 10\.0\.\d+\.\d+ Mr\. \w+ (\w+), Mrs\. \1; Herr \w+ 48\d{14} 45\d\d-\d{4}-\d{4}-\d{4} \d{3}-\d\d-\d{4} token = \"[0-9a-f]{40}\"$", made)
    given = re.search(r"Mr\. (\w+)", made)[1]
    assert given in pii.GIVEN["latin", "m"]
    for old in text.split():
        if any(c.isdigit() for c in old) and old != "+1":
            assert old not in made
    for card in re.findall(r"48\d{14}|45[\d-]{17}", made):
        d = [int(c) for c in card if c.isdigit()][::-1]
        assert (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
    assert pii.replace_pii(df, secret_key="other").filter("doc_id = 2").first()["text"] != by[2]["text"]
    assert pii.replace_pii(df.limit(0), secret_key="k").collect() == []


def test_collisions_are_drawn_again(spark):
    """Names drawn from a tiny range: still distinct, and never a value of the table."""
    values = [f"Mr. N{chr(97 + i)}me" for i in range(12)] + ["Mr. Xa"]

    def draw(ident, key, attempt):
        n = F.pmod(F.xxhash64(F.concat(F.lit(key), ident, attempt.cast("string"))), F.lit(26)).cast("int")
        return F.concat(F.lit("family|x"), F.char(n + 97))

    df = spark.createDataFrame([(i, f"{v} met {v}.") for i, v in enumerate(values)], "doc_id long, text string")
    out = [r["text"] for r in pii.replace_pii(df, secret_key="k", draw=draw).collect()]
    names = [re.fullmatch(r"(Mr\. X[a-z]) met \1\.", t)[1] for t in out]
    assert len(set(names)) == len(values) and not set(names) & set(values)


def test_small_spaces_are_widened(spark):
    """Every one-letter address of a domain, and many men of one family, get distinct surrogates."""
    mails = [f"{chr(97 + i)}@tiny.org" for i in range(26)]
    people = [f"Mr. G{chr(97 + i // 26)}{chr(97 + i % 26)} Stone" for i in range(60)]
    rows = list(enumerate([*(f"write to {m} now" for m in mails), *(f"{p} spoke. Later Mr. Stone left" for p in people), "MR. STONE is not Herr STONE or Mr. Stone"]))
    df = spark.createDataFrame([(*r, 1, {"a": 1}) for r in rows], "doc_id long, text string, again int, found map<string,int>")
    result = pii.replace_pii(df, secret_key="k")
    assert result.columns == [*df.columns, "pii_types"]
    out = [r["text"] for r in result.orderBy("doc_id").collect()]
    made = [re.fullmatch(r"write to (\S+@mail\d+\.example\.org) now", t)[1] for t in out[:26]]
    assert len(set(made)) == 26 and not {m.split("@")[0] for m in made if len(m.split("@")[0]) == 1} - set("abcdefghijklmnopqrstuvwxyz")
    full = [re.fullmatch(r"(Mr\. \w+) (\w+) spoke\. Later Mr\. \2 left", t) for t in out[26:86]]
    assert len({m[1] for m in full}) == 60 and len({m[2] for m in full}) == 1
    family = full[0][2]
    assert out[86] == f"MR. STONE is not Herr {family.upper()} or Mr. {family}"


def test_one_identity_in_many_formats(spark):
    texts = ["+1 (743) 555-3824", "+17435553824", "(743) 555-3824", "743-555-3824", "+1.743.555.3824", "+44 743 555 3824", "Ab.Cd@Ef.com", "ab.cd@ef.COM", "AB.CD@EF.COM",
             "4845168114407329", "4845-1681-1440-7329", "+1 (826) 555-4081 190.137.20.5", "password: Zx9_abcdefghijklm=", "api_key = 'abc.DEF-123456789012=='"]
    out = [r["text"] for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), secret_key="k").orderBy("doc_id").collect()]
    digits = ["".join(c for c in t if c.isdigit()) for t in out]
    assert len({d[-10:] for d in digits[:5]}) == 1 and digits[0][0] == "1" and digits[5].startswith("44") and digits[5][2:] != digits[0][1:]
    shape = lambda t: re.sub(r"\d", "9", t)
    assert [shape(t) for t in out[:6]] == [shape(t) for t in texts[:6]]
    assert len({t.lower() for t in out[6:9]}) == 1 and out[8] == out[8].upper() and out[6].split("@")[0][0].isupper() and out[7].split("@")[0].islower()
    assert digits[9] == digits[10] and out[10].count("-") == 3
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} \d+\.\d+\.\d+\.\d+", out[11]) and "190.137" not in out[11]
    assert out[12].startswith("password: ") and out[12] != texts[12] and len(out[12]) == len(texts[12]) and re.fullmatch(r"api_key = '[a-z]{3}\.[A-Z]{3}-\d{12}=='", out[13])


def plain_kind(value):
    """The type of a match, said once more in Python."""
    digits = "".join(c for c in value if c.isdigit())
    if re.match(rf"(?i:{pii._SECRET_NAME})[\"']?\s*[=:]", value):
        return "secret"
    if "@" in value:
        return "email"
    if re.match(rf"(?:{pii._TITLE})\b", value):
        return "person"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", value):
        return "ssn"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", value):
        return "ip" if all(int(x) < 256 for x in value.split(".")) else None
    if re.fullmatch(r"\d[\d -]*\d", value) and len(digits) in (15, 16):
        d = [int(c) for c in digits][::-1]
        fits = (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
        return "card" if fits and re.match("4|5[1-5]|2[2-7]|3[47]|6011|65", digits) else None
    return "phone"


def test_query_against_a_plain_search(spark):
    """Every document of the query: what stands between entities is as before, types are
    those of a plain search, and surrogates are one to one, of the same form, and new."""
    import regex

    sf = "/root/testdata/sf0.01"
    old = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("old"))
    pattern, made, real = regex.compile(pii.ENTITY), {}, set()
    lower = lambda v: v.lower() if "@" in v else v
    for r in queries.op4_pii_surrogates(spark, sf).join(old, "doc_id").collect():
        if r["old"] is None:
            assert r["text"] is None
            continue
        found = [(m.group(), plain_kind(m.group())) for m in pattern.finditer(r["old"])]
        assert (r["pii_types"] or "") == ",".join(k for _, k in found if k)
        at, pieces = 0, pattern.split(r["old"])
        for i, piece in enumerate(pieces):
            assert r["text"].startswith(piece, at)
            at += len(piece)
            if i < len(found):
                value, kind = found[i]
                after = r["text"].find(pieces[i + 1], at + 1) if pieces[i + 1] else len(r["text"])
                if kind is None:
                    after = at + len(value)
                    assert r["text"][at:after] == value
                elif kind in ("ip", "email"):  # the only ones whose length may change
                    after = at + pattern.match(r["text"], at).end() - at if pattern.match(r["text"], at) else after
                else:
                    after = at + len(value)
                if kind:
                    got = r["text"][at:after]
                    assert made.setdefault((kind, lower(value)), lower(got)) == lower(got) and lower(got) != lower(value)
                    real.add((kind, lower(value)))
                    assert plain_kind(got) == kind and (kind in ("ip", "email") or re.sub(r"\d", "9", got).lower()[:5] == re.sub(r"\d", "9", value).lower()[:5] or kind in ("person", "secret"))
                at = after
        assert at == len(r["text"])
    assert len(made) > 50 and len(set(made.items())) == len({(k, g) for (k, _), g in made.items()})
    assert not {(k, g) for (k, _), g in made.items()} & real


def test_planted_private_data_goes_and_clean_text_stays(spark):
    sf = "/root/testdata/sf0.01"
    old = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("old"))
    rows = queries.op4_pii_surrogates(spark, sf).join(old, "doc_id").collect()
    private = r"\S+@\S+\.com|\+\d+ \(\d+\) \d+-\d+|(?<![\d.])(?:\d+\.){3}\d+|(?<=token = \")\w+|(?<=TOKEN = \")\w+"
    for r in rows:
        found = re.findall(private, r["old"])
        assert (r["text"] != r["old"]) == (r["n_entities"] > 0) and r["n_entities"] >= len(found)
        assert not any(f in r["text"] for f in found)
    assert sum(r["n_entities"] for r in rows) > 50


# --- licences ----------------------------------------------------------------------------


def test_licences(spark):
    mit = licenses.KNOWN_TEXTS["MIT"][0]
    variants = [mit, mit.upper(), "Copyright (c) 2020 Someone\n\n" + mit, "MIT Licence\n" + re.sub(r"\s+", "   ", mit), mit.replace("sublicense", "sub-license")]
    rows = [(i, v) for i, v in enumerate(variants)] + [(10, mit + " extra"), (11, None), (12, ""), (13, "code\nReleased under the MIT licence\nmore"), (13, "code\nReleased under the MIT licence\nmore")]
    rows += [(14, "Licensed under the Apache License, Version 2.0.\nreleased UNDER the mit license!"), (15, "no licence here")]
    df = spark.createDataFrame([(*r, "MIT") for r in rows], "doc_id long, text string, license string")
    out = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert [out[i]["license"] for i in range(5)] == ["MIT"] * 5 and out[10]["license"] is None
    assert out[11]["text_digest"] is None and out[11]["notices"] == [] and out[12]["n_canonical_chars"] == 0
    assert out[13]["notices"] == ["MIT"] and out[14]["notices"] == ["Apache-2.0", "MIT"] and out[15]["notices"] == []
    assert licenses.scan_licenses(df).count() == len(rows) and licenses.scan_licenses(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.known_digests(spark, {"x": ("a",) * (licenses.MAX_KNOWN + 1)})


def test_licences_however_wrapped(spark):
    import textwrap

    texts = [(name, " ".join(licenses.KNOWN_TEXTS[name][0].split())) for name in ("MIT", "ISC", "Zlib", "BSD-3-Clause")]
    rows = [(w, textwrap.fill(t, w), name) for name, t in texts for w in range(38, 111, 3)]
    rows += [(1, t, name) for name, t in texts] + [(2, "Copyright 2020 A. Author. All rights reserved.\n© B\n(c) 2021 C\n\n" + t + "\nAll rights\nreserved.", name) for name, t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    keyed = df.withColumn("doc_id", F.monotonically_increasing_id())
    out = licenses.scan_licenses(keyed).join(keyed.select("doc_id", "want"), "doc_id").collect()
    assert len(out) == len(rows) and [r for r in out if r["license"] != r["want"]] == []


def test_licence_tables_cover_usual_notices_and_texts(spark):
    notices = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        " * This program is distributed under the terms of the GNU General Public License v2 or later": "GPL-2.0-or-later",
        "# SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
        "This file is released under CC BY-ND 3.0": "CC-BY-ND-3.0",
        "Available under CC0 1.0": "CC0-1.0",
        "This software is licensed under the Mozilla Public License, v. 2.0.": "MPL-2.0",
    }
    texts = {"GPL-3.0", "GPL-2.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Apache-2.0", "CC0-1.0", "Unlicense"}
    rows = [(i, f"some text\n{line}\nmore text", name) for i, (line, name) in enumerate(notices.items())]
    rows += [(100 + i, "Copyright (c) 2020 Someone\n" + licenses.KNOWN_TEXTS[name][0].upper(), name) for i, name in enumerate(sorted(texts))]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    out = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert [out[i]["notices"] for i in range(len(notices))] == [[n] for n in notices.values()]
    assert {out[i]["license"] for i in out if i >= 100} == texts
    # no form stands for two licences
    for known in (licenses.KNOWN_TEXTS, licenses.KNOWN_NOTICES):
        pairs = [(n, t) for n, ts in known.items() for t in ts]
        forms = spark.createDataFrame(pairs, "name string, body string").select("name", licenses.canonical(F.col("body")).alias("form"))
        assert forms.groupBy("form").agg(F.collect_set("name").alias("names")).filter("size(names) > 1 or form = ''").collect() == []


# --- mixing ------------------------------------------------------------------------------


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
        if c >= 1 or p < 1e-300:
            break
    return k


def test_mixing_counts_and_order(spark):
    rows = [(i, "abc"[i % 3] if i % 50 else None, f"t{i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, k int")
    weights = {"a": 3.0, "b": 1.0, "c": 0.0}
    out = mixing.mix(df, weights, target_rows=8000, seed="s", default_weight=1.0)
    got = out.collect()
    sizes = Counter(s for _, s, _ in rows)
    counts = Counter(r["doc_id"] for r in got)
    for i, s, _ in rows:
        rate = weights.get(s, 1.0) / 5.0 * 8000 / sizes[s]
        u = int(hashlib.md5(f"s:count:{i}".encode()).hexdigest()[:13], 16) / 16**13
        assert counts[i] == poisson(u, rate), (i, s)
    assert abs(len(got) - 8000) < 5 * math.sqrt(8000) and not any(r["source"] == "c" for r in got)
    keys = [r["mix_key"] for r in got]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert mixing.mix(df, weights, target_rows=8000, seed="s", keep_marks=False).columns == df.columns
    assert mixing.mix(df.limit(0), weights).collect() == []
    again = mixing.mix(df.repartition(7), weights, target_rows=8000, seed="s").collect()
    assert [r["mix_key"] for r in again] == keys


def draws(spark, rate, n=4000):
    df = spark.range(n).select(mixing.unit_interval("x", F.col("id").cast("string")).alias("u"))
    rates = spark.createDataFrame([("s", rate)], "name string, rate double")
    table = mixing.poisson_tables(rates, "name", "rate").first()
    if table is None:
        return np.array([r[0] for r in df.select(mixing.poisson_draw(F.col("u"), F.lit(None).cast("struct<least:bigint,sums:array<double>,steps:array<int>>"))).collect()])
    made = df.crossJoin(F.broadcast(mixing.poisson_tables(rates, "name", "rate")))
    return np.array([r[0] for r in made.select(mixing.poisson_draw(F.col("u"), F.col("table"))).collect()])


@pytest.mark.parametrize("rate", [0.01, 1.0, 37.5, 500.0, 2400.0, 30000.0])
def test_poisson_distribution(spark, rate):
    """Mean, variance and shape: each tenth of the distribution holds a tenth of the draws."""
    n = 4000
    values = draws(spark, rate, n)
    assert abs(values.mean() - rate) < 5 * math.sqrt(rate / n) + 1e-9
    spread = 5 * math.sqrt((2 * rate**2 + rate) / n)  # five standard errors of a Poisson variance
    assert abs(values.var() - rate) < spread + 1e-9
    # cells of neighbouring numbers, each with a tenth of the draws at least
    cells, held, low = [], 0.0, -1
    for k in range(int(rate + 12 * math.sqrt(rate) + 30)):
        held += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if held >= 0.1:
            cells.append((low, k, held))
            held, low = 0.0, k
    cells[-1] = (cells[-1][0], math.inf, 1 - sum(c[2] for c in cells[:-1]))
    chi = sum((((values > a) & (values <= b)).sum() - n * p) ** 2 / (n * p) for a, b, p in cells)
    assert chi < 45  # at most 9 degrees of freedom: beyond any chance


def test_poisson_against_exact_sums(spark):
    for rate in (0.3, 2.0, 55.0):
        u = [int(hashlib.md5(f"x:{i}".encode()).hexdigest()[:13], 16) / 16**13 for i in range(500)]
        assert draws(spark, rate, 500).tolist() == [poisson(x, rate) for x in u]
    for rate in (-1.0, None, 0.0):
        assert not draws(spark, rate, 50).any()


def test_mixing_names_in_use_and_hot_keys(spark):
    rows = [(7 if i % 3 else i, "s", f"t{i}", 1, 2, "k") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, rate int, `count` int, mix_key string")
    out = mixing.mix(df, target_rows=1800, told_by=["text"])
    assert out.columns == ["doc_id", "source", "text", "rate", "count", "mix_rate", "mix_copy", "mix_key"]
    got = out.withColumn("part", F.spark_partition_id()).collect()
    assert len({r["mix_key"] for r in got}) == len(got) and {r["rate"] for r in got} == {1}
    hot = Counter(r["part"] for r in got if r["doc_id"] == 7)
    assert not hot or len(hot) == 4
    bare = mixing.mix(df, target_rows=1800, keep_marks=False)
    assert bare.columns == df.columns and {r["mix_key"] for r in bare.collect()} <= {"k"}
    null = spark.createDataFrame([(None, None, None)], "doc_id long, source string, text string")
    assert mixing.mix(null, target_rows=50).select("doc_id", "source").distinct().collect() == [(None, None)]


# --- WARC --------------------------------------------------------------------------------


def record(*fields):
    return dict(zip(("record_id", "warc_type", "url", "ts", "status", "headers", "extra"), fields, strict=False))


RECORDS = "record_id string, warc_type string, url string, ts long, status int, headers map<string,string>, canonical string"


def test_revisits(spark):
    rows = [
        ("r1", "response", "http://www.a.org/x/", 10, 200, {"ETag": "\"1\"", "Content-Type": "text/html", "Date": "d1"}), ("r2", "response", "https://a.org/x?utm_source=f", 20, None, {"etag": "\"2\"", "Date": "d2"}),
        ("r3", "response", "http://a.org/x", 30, 404, {"ETag": "\"3\""}), ("v1", "revisit", "http://m.a.org:80/x#f", 15, 304, {"ETag": "W/\"1\"", "Date": "d9", "Content-Type": "no", "X": "y"}),
        ("v2", "revisit", "http://a.org/x", 40, 304, {"ETag": "\"1\""}), ("v3", "revisit", "http://a.org/x", 5, 304, None), ("v4", "revisit", "http://a.org/x", 2_000_000, 304, {"Expires": "e"}),
        ("v5", "revisit", None, 50, 304, {}), ("v6", "revisit", "http://a.org/x", None, 304, {}), ("q", "request", "http://a.org/x", 41, None, {}), ("r4", "response", "http://b.org/?b=2&a=1", 7, 200, {"Last-Modified": "m"}),
        ("v7", "revisit", "http://b.org?a=1&b=2&gclid=3", 7, 304, {"last-modified": "m"}), ("v7", "revisit", "http://b.org?a=1&b=2&gclid=3", 7, 304, {"last-modified": "m"}), ("v8", "revisit", "http://b.org/?a=1&b=2", 8, 304, {"last-modified": "n"}),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], RECORDS)
    for slot in (1, 4, 50):
        out = warc.resolve_revisits(df, slots=slot).collect()
        got = {r["record_id"]: (r["response_id"], r["outcome"]) for r in out}
        assert got == {
            "v1": ("r1", "resolved"), "v2": ("r2", "mismatch"), "v3": (None, "missing"), "v4": ("r2", "unverified"), "v5": (None, "missing"), "v6": (None, "missing"),
            "v7": ("r4", "resolved"), "v8": ("r4", "mismatch"),
        }, slot
        assert len(out) == 9
    merged = next(r["headers"] for r in out if r["record_id"] == "v1")
    assert merged == {"etag": "W/\"1\"", "content-type": "text/html", "date": "d9"}
    assert warc.resolve_revisits(df.limit(0)).collect() == []


def test_revisits_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(f"{i:04d}", rng.choice(["response", "revisit"]), f"http://h/{'hot' if rng.random() < 0.4 else rng.randrange(9)}", rng.randrange(60), 200, {"ETag": str(rng.randrange(2))}, None) for i in range(400)]
    got = {r["record_id"]: r["response_id"] for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS), slots=40).collect()}
    for i, kind, url, ts, *_ in rows:
        if kind == "revisit":
            before = [(t, j) for j, k, u, t, *_ in rows if k == "response" and u == url and (t, j) < (ts, i)]
            assert got[i] == (max(before)[1] if before else None)


def test_repeated_headers_and_bodies(spark):
    df = spark.sql("""
      select * from values
        ('r', 'response', 'http://a/x', 1L, 200, map('ETag', '1', 'etag', '2', 'ETAG', '3'), binary('body')),
        ('v', 'revisit', 'http://a/x', 2L, 304, map('etag', '0', 'Etag', '3'), binary('')),
        ('w', 'revisit', 'http://a/x', 3L, 304, map('etag', '9'), binary('own')),
        ('u', 'revisit', 'http://b', 3L, 304, null, null)
      as t(record_id, warc_type, url, ts, status, headers, payload)""")
    out = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert out["v"]["outcome"] == "resolved" and out["v"]["payload"] == b"body" and out["v"]["headers"] == {"etag": "3"}
    assert out["w"]["outcome"] == "mismatch" and out["w"]["payload"] == b"own"
    assert out["u"]["outcome"] == "missing" and out["u"]["payload"] is None and out["u"]["headers"] == {}


def test_warc_files(spark, tmp_path):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nETag: \"1\"\r\n\r\n<p>hi</p>"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + head + http + b"\r\n\r\n" + head + http[:5])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(head + http + b"\r\n\r\n"))
    (tmp_path / "c.warc").write_bytes(b"")
    nested = info.replace(b"Content-Length: 2", b"Content-Length: %d" % (2 * len(info))).replace(b"warcinfo", b"resource").replace(b"\r\n\r\nhi", b"\r\n\r\n" + 2 * info)
    bad = info.replace(b"Length: 2", b"Length: two").replace(b"warcinfo", b"bad")
    (tmp_path / "d.warc").write_bytes(b"junk" + bad + nested + info.replace(b"warcinfo", b"after"))
    whole = gzip.compress(info + head + http + b"\r\n\r\n") + gzip.compress(info.replace(b"h: 2", b"h: 500000") + random.Random(1).randbytes(500_000))
    (tmp_path / "e.warc.gz").write_bytes(whole[: len(whole) - 1000])
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert Counter(r["warc_type"] for r in rows) == {"warcinfo": 3, "response": 3, "resource": 1, "after": 1}
    assert next(r for r in rows if r["warc_type"] == "resource")["payload"] == 2 * info
    response = next(r for r in rows if r["warc_type"] == "response")
    assert response["payload"] == b"<p>hi</p>" and response["status"] == 200 and response["headers"]["etag"] == "\"1\"" and response["ts"] == 1704164645


INFO = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
HTTP = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: 2024-01\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 -\r\n\r\nabc\r\n\r\n"
DAMAGED = {
    "cut off": INFO + INFO[:-5],
    "no valid length": INFO + INFO.replace(b"Length: 2", b"Length: two"),
    "bytes behind the payload": INFO + INFO.replace(b"hi", b"hi and more"),
    "no record at the beginning": b"<html>503</html>",
    "no valid date": HTTP.replace(b"2024-01", b"yesterday"),
    "no valid status line": HTTP.replace(b"HTTP/1.1 200", b"HTTP/1.1 -no"),
}


@pytest.mark.parametrize("packed", [False, True])
def test_damaged_warc_is_no_result(spark, tmp_path, packed):
    """Damage is an error that names the file, or a row of the report."""
    import gzip

    put = lambda data: gzip.compress(data) if packed else data
    for i, (reason, data) in enumerate(DAMAGED.items()):
        file = tmp_path / f"{i}.warc{'.gz' if packed else ''}"
        file.write_bytes(put(data))
        with pytest.raises(Exception, match=f"{file.name}: {reason}"):
            warc.read_warc(spark, str(file), damaged="fail").collect()
    rows = warc.read_warc(spark, str(tmp_path), damaged="report").collect()
    assert sorted(r["damage"] for r in rows if r["damage"]) == sorted(DAMAGED)
    assert sum(r["damage"] is None for r in rows) == 3 == warc.read_warc(spark, str(tmp_path)).count()


def test_broken_gzip_is_no_result(spark, tmp_path):
    import gzip

    whole = gzip.compress(INFO) + gzip.compress(HTTP) + bytes(100)
    flipped = bytearray(whole)
    flipped[len(gzip.compress(INFO)) - 5] ^= 1  # in the checksum
    for name, data, least in (("short", whole[:-105], 2), ("flipped", bytes(flipped), 0), ("junk", b"<html>", 0)):
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
        with pytest.raises(Exception, match=f"{name}.warc.gz: "):
            warc.read_warc(spark, str(tmp_path / f"{name}.warc.gz"), damaged="fail").collect()
        rows = warc.read_warc(spark, str(tmp_path / f"{name}.warc.gz"), damaged="report").collect()
        assert sum(r["damage"] is None for r in rows) == least and any("gzip" in (r["damage"] or "") for r in rows)
    (tmp_path / "good.warc.gz").write_bytes(whole)
    good = warc.read_warc(spark, str(tmp_path / "good.warc.gz"), damaged="fail").collect()
    assert [(r["warc_type"], r["ts"], r["payload"]) for r in good] == [("warcinfo", None, b"hi"), ("response", 1704067200, b"abc")]


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_unreadable_warc_is_an_error(spark, tmp_path, name):
    """A read that fails is none of the file's damage, so it is never skipped."""
    import gzip

    (tmp_path / name).write_bytes(gzip.compress(INFO) if name.endswith("gz") else INFO)
    (tmp_path / f".{name}.crc").write_bytes(b"crc\0" + (512).to_bytes(4, "big") + b"\1\2\3\4")
    for damaged in ("skip", "report", "fail"):
        with pytest.raises(Exception, match="(?i)checksum"):
            warc.read_warc(spark, str(tmp_path / name), damaged=damaged).collect()


def test_records_beside_damage_are_kept(spark, tmp_path):
    """Marks in heads, and lengths that reach into the next records."""
    import gzip

    address = INFO.replace(b"Content", b"WARC-Target-URI: http://a/WARC/1.1/\r\nContent")
    for i, length in enumerate((6, 7, 40, 10**6, 10**30)):
        data = address + INFO.replace(b"Length: 2", b"Length: %d" % length).replace(b"warcinfo", b"bad") + 3 * address
        (tmp_path / f"{i}.warc").write_bytes(data)
        (tmp_path / f"{i}.warc.gz").write_bytes(gzip.compress(data))
    got = warc.read_warc(spark, str(tmp_path), damaged="report").collect()
    assert Counter(r["url"] for r in got if r["damage"] is None) == {"http://a/WARC/1.1/": 40}
    assert Counter(r["file"].rsplit("/", 1)[1] for r in got if r["damage"]) == {f"{i}.warc{z}": 1 for i in range(5) for z in ("", ".gz")}


def test_gzip_bytes_come_through_rows(spark, tmp_path):
    """Stored and compressed, whatever line ends the bytes hold."""
    import gzip

    rng, sent = random.Random(3), []
    for i, end in enumerate((b"\r\n", b"\r", b"\n", b"\r\r\n", b"")):
        body = rng.randbytes(200_000) + 3 * end
        data = INFO.replace(b"h: 2", b"h: %d" % len(body)).replace(b"hi", body, 1)
        for level in (0, 9):
            sent.append(body)
            (tmp_path / f"{i}-{level}.warc.gz").write_bytes(gzip.compress(data, level))
    got = warc.read_warc(spark, str(tmp_path), damaged="fail").collect()
    assert sorted(bytes(r["payload"]) for r in got) == sorted(sent)
    body = b"\0" * 0x0A0D0000  # its size ends the file in a cut
    packed, faults = gzip.compress(body, 1), []
    assert packed.endswith(b"\r\n") and sum(map(len, warc._gunzip(iter([packed[:-2]]), faults))) == len(body) and not faults
    assert sum(map(len, warc._gunzip(iter([packed[:-3]]), faults))) == len(body) and faults == ["the gzip file breaks off"]
