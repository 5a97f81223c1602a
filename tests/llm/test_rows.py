"""Operators that judge each row by itself, against brute force."""

import fnmatch
import hashlib
import math
import random
import re
import struct
import textwrap
import time
import zlib
from collections import Counter
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from kindred.llm import license_scan, media, pieces, quality, toxicity, url_filter
from kindred.llm import queries as q
from kindred.llm.license_texts import DIGESTS, LICENSES
from tests.llm.conftest import prose


def by(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if c < "\x80" else c for c in host)
    fits = [r for r in q.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: (len(r.name), r.verdict == "block")) if fits else None


def test_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://Example.ORG/es/x", "https://a.b.example.org/en/123?q=/de/", "https://example.org", "http://org/", "http://evilorg/", "ftp://x.com/de/y#z", "http://com/fr/", "http://x.com/it/",
            "a://b://c.org/", "http://É.Com/de/", "http://x.org/" + "p" * 100_000, "http://notexample.org/es/", "http://x.com?/de/", "http://x.com/d", "//x.org/"] * 2
    rows = [(i, u, "c") for i, u in enumerate(urls)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("__k", F.lit("kept")), q.RULES)
    for r in got.collect():
        host, path, rule = brute_rule(urls[r["page_id"]])
        assert r["__k"] == "kept"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule and rule.name, rule.verdict if rule else "allow")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), q.RULES).count() == 0


def test_automaton_of_many_words():
    """More patterns than fit one word of 64 bits, against a matcher of the standard library."""
    rng = random.Random(3)
    globs = ["".join(rng.choice("ab?*/") for _ in range(rng.randint(1, 12))).replace("**", "*").replace("*", "**") for _ in range(40)]
    texts = ["".join(rng.choice("ab/é") for _ in range(rng.randint(0, 15))) for _ in range(500)]
    found = url_filter.Automaton(globs).matches([t.encode() for t in texts])
    for g, glob in enumerate(globs):
        pattern = re.compile(fnmatch.translate(glob.replace("**", "*")), re.S)
        assert [bool(pattern.match(t)) for t in texts] == list(found[:, g])
    one = url_filter.Automaton(["*.org/x**", "a?c"]).matches([b"a.org/x/y", b"a/b.org/x", b"a\xc3\xa9c", b"abc", b"ac"])
    assert one.tolist() == [[True, False], [False, False], [False, True], [False, True], [False, False]]


def test_media(spark, odd_documents):
    got = by(media.describe(media.store_text(odd_documents)))
    for r in odd_documents.collect():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        own = got[r["doc_id"]]
        assert (own["n_bytes"], own["payload_bytes"]) == (len(raw), len(payload))
        assert own["payload_sha256"] == hashlib.sha256(payload).hexdigest() and own["tail_crc32"] == zlib.crc32(payload[-64:])
        assert own["media_bytes"] == 44 + len(payload) and own["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest()
        assert own["feature"].startswith("application/octet-stream>audio/wav")
    assert media.describe(media.store_text(odd_documents.limit(0))).count() == 0


def png(wide=3, high=2):
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", wide, high, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes(high * (wide + 1)))) + chunk(b"IEND", b"")


def test_sniffing(spark):
    magic = media.automaton()
    wav, image = media.to_wav(b"ab" * 50), png()
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + bytes(9) + b"\x02\x02\x4c\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cdscan\xff\xd9"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    gz = __import__("gzip").compress(b"hello" * 1000)
    pdf = b"%PDF-1.4\nstuff\nstartxref\n0\n%%EOF"
    for one, kind in ((wav, "audio/wav"), (image, "image/png"), (gif, "image/gif"), (jpeg, "image/jpeg"), (bmp, "image/bmp"), (gz, "application/gzip"), (pdf, "application/pdf")):
        assert media.corrected_type(one, "text/plain", magic) == kind
        assert media.carve(b"RIFF BM junk" + one + b" GIF89a tail", magic)[:1] == [one]
        assert not media.sniff(one[:-3] if kind != "application/pdf" else one[:-6], magic)
    assert media.carve(media.to_wav(image + b"x"), magic)[1:] == [image]
    assert media.corrected_type(b"plain", "image/png", magic) == "image/png"
    broken = bytearray(image)
    broken[20] ^= 1
    assert not media.sniff(bytes(broken), magic)
    assert media.describe(spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")).first()["payload_bytes"] == 0


def brute_feature(data, declared="application/octet-stream"):
    """From what the text is alone: no magic but letters can be in it, and of those only whole media count."""
    payload = data[44 : 44 + struct.unpack("<I", data[40:44])[0]]
    counts = Counter(payload)
    entropy = abs(-sum(n / len(payload) * math.log2(n / len(payload)) for n in counts.values()))
    return f"{declared}>audio/wav 1x8@8000/{len(payload)} {entropy:.4f} "


def test_features(spark, sf, odd_documents):
    docs = odd_documents.select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id > 10"))
    whole = b"%PDF-1.4 startxref 0 %%EOF"
    docs = docs.union(spark.createDataFrame([(-1, f"a {whole.decode()} b GIF89a BM RIFF"), (-2, "%PDF- startxref"), (-3, "BM" * 40)], docs.schema)).cache()
    got = {}
    for r in media.describe(media.store_text(docs)).collect():
        got.setdefault(r["doc_id"], r["feature"])
    for r in docs.collect():
        want = brute_feature(media.to_wav(media.padded((r["text"] or "").encode())))
        assert got[r["doc_id"]] == want + str(int(r["doc_id"] == -1))


def test_long_media():
    """Scans stay linear: magic without end, chains that fail, and containers in containers."""
    magic, start = media.automaton(), time.time()
    assert media.sniff(b"%PDF-" * 2_000_000, magic) == []
    assert len(media.sniff(b"%PDF-" * 1_000_000 + b"startxref %%EOF", magic)) == 1
    assert media.sniff((b"\xff\xd8\xff\xda\x00\x02") * 300_000, magic) == []
    assert media.sniff(b"GIF89a" * 500_000, magic) == [] and media.sniff(b"GIF89a" + b"!\xf9\x04GIF89" * 200_000, magic) == []
    nested = b"RIFF"
    for _ in range(5000):
        nested = media.to_wav(nested)
    found = media.carve(nested, magic)
    assert len(found) == 5000 and found[0] == nested and found[-1] == media.to_wav(b"RIFF")
    assert time.time() - start < 60


def test_media_behind_samples():
    """What follows a container's samples within it isn't searched; what follows the container is."""
    magic, image = media.automaton(), png()
    wav = media.to_wav(b"ab")
    more = b"LIST" + struct.pack("<I", len(image) + len(image) % 2) + image + bytes(len(image) % 2)
    wide = b"RIFF" + struct.pack("<I", len(wav) - 8 + len(more)) + wav[8:] + more
    assert media.carve(wide + image, magic) == [wide, image] and media.carve(media.to_wav(image + image) + image, magic)[1:] == [image] * 3


def test_licenses(spark, odd_documents):
    texts = [LICENSES["MIT"].upper().replace("\n", "\r\n  "), "Copyright 2020 Me\n" + LICENSES["BSD-2-Clause"], LICENSES["Zlib"].replace("acknowledgment", "acknowledgement").replace('"', "“"), "see " + LICENSES["ISC"], None, ""]
    want = ["MIT", "BSD-2-Clause", "Zlib", None, None, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("license_id", F.lit("clash"))
    got = by(license_scan.scan(df))
    assert [got[i]["license_id"] for i in range(6)] == want and got[4]["license_digest"] == hashlib.sha256(b"").hexdigest()
    body = LICENSES["BSD-2-Clause"]
    wrapped = [(w, "\n".join(textwrap.wrap(" ".join(body.split()), w))) for w in range(30, 100)]
    notices = ["Copyright (c) <year> <holder>", "(c) 2001-2020 A, B", "© A", "Copyright 2020 Me. All rights reserved.", "# COPYRIGHT © 1999"]
    tops = [(1000 + k, n + "\n\n" + LICENSES["MIT (no title)"]) for k, n in enumerate(notices)]
    df = spark.createDataFrame(wrapped + tops, "doc_id long, text string")
    assert {r["license_id"] for r in license_scan.scan(df).where("doc_id < 1000").collect()} == {"BSD-2-Clause"}
    assert {r["license_id"] for r in license_scan.scan(df).where("doc_id >= 1000").collect()} == {"MIT (no title)"}
    assert not license_scan.known(spark).where("license_id like '%(line)%'").count()
    odd = license_scan.scan(odd_documents)
    assert odd.count() == 10 and odd.where("license_id is not null").count() == 0
    assert license_scan.scan(odd_documents.limit(0)).count() == 0


def test_full_licences(spark):
    """Digests of long licences against the texts that many systems keep."""
    folder = Path("/usr/share/common-licenses")
    names = [n for n in DIGESTS.values() if (folder / n).exists()]
    if not names:
        pytest.skip("no such texts here")
    df = spark.createDataFrame([(n, (folder / n).read_text(errors="replace")) for n in names], "doc_id string, text string")
    got = by(license_scan.scan(df))
    assert all(got[n]["license_id"] == n for n in names) and len(names) >= 5
    again = license_scan.scan(df.withColumn("text", F.regexp_replace(F.upper("text"), " +", "  "))).where("license_id is null")
    assert again.count() == 0


def test_pieces(spark, odd_documents, sf):
    sp = pytest.importorskip("sentencepiece")
    model = q.piece_model()
    own, theirs = pieces.Pieces(model, memo=1000), sp.SentencePieceProcessor(model_file=model)
    rng = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "the", "ing", "▁", "é", "日", "😀", "\0", "\t", "x", "er", "aaa", "0", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [" " * k for k in range(70)] + ["</s><unk>", prose(3, 500)]
    for t in texts:
        ids = theirs.encode(t, add_eos=True)
        assert own.encode(t) == ids and own.decode(ids) == theirs.decode(ids)
    assert all(own.by_table(w) in (None, own.merge(w)) for t in texts for w in own.parts(t) if "▁▁" not in w)
    docs = odd_documents.select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id > 10"))
    got = by(pieces.encode_table(docs, model, ids=True))
    for r in docs.collect():
        ids = theirs.encode(r["text"] or "", add_eos=True)
        x = got[r["doc_id"]]
        assert x["n_tokens"] == len(ids) and x["ids"] == ids and x["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()
    assert pieces.encode_table(odd_documents.limit(0), model).count() == 0


@pytest.mark.parametrize("name,label,least", [("op4_toxicity", "toxic", 0.9), ("op7_quality", "quality", 0.97)])
def test_held_out(spark, sf, name, label, least):
    rows = q.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 40 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == r[label] for r in rows) / len(rows) >= least
    mod, rest = (5, 0) if label == "toxic" else (3, 1)
    held = {r["doc_id"]: r["held_out"] for r in q.QUERIES[name](spark, sf).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % mod == rest) for i, h in held.items())


def test_toxicity_finds_what_a_constant_does_not(spark, sf):
    larger = Path(sf).parent / "sf0.1"
    if not larger.exists():
        pytest.skip("needs a few thousand labels")
    rows = q.QUERIES["op4_toxicity"](spark, str(larger)).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit >= 0.75 * sum(r["toxic"] for r in rows) and hit >= 0.9 * sum(r["predicted"] for r in rows)


def test_toxicity_scores(spark, sf):
    """Scores against a plain reading of the method with the model's own dictionaries."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.toxic != model.ordinary and all(d[:4] == b"\x37\xa4\x30\xec" for d in (model.toxic, model.ordinary))
    toxic, ordinary = toxicity._compressor(model.toxic), toxicity._compressor(model.ordinary)
    got = by(toxicity.score(docs, model))
    for r in docs.collect():
        seen, stream = Counter(), b""
        for w in re.findall(r"\w+", r["text"].lower()):
            seen[w] += 1
            step = max(n for n in (1, 2, 3, 5) if n <= seen[w])
            stream += xxhash.xxh3_128_digest(w + f" {step}" if step > 1 else w)
        windows = [stream[k : k + 32] for k in range(0, len(stream), 32)]
        gains = [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows]
        beyond = sum(max(0, g - 5) for g in gains) / 16 - model.rate * len(gains)
        x = [max((g for g in gains if g > 5), default=0) / 16, math.log1p(max(0, beyond)), beyond / math.sqrt(max(1, len(gains)))]
        z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x))
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_words_are_read_whole():
    """Words alike in their first letters, the whole of a word, unspaced scripts, case, and the step of a count."""
    codes = toxicity.Codes()
    one = toxicity.recode("stupid Stupid STUPID stupor stupendous a-b", codes)
    assert len(set(one)) == 7 and all(len(c) == toxicity.CODE for c in one)
    assert toxicity.recode("STUPID", codes) == one[:1] and len(toxicity.recode("日本語の長い文章です", codes)) == 10
    assert toxicity.recode(None, codes) == toxicity.recode("", codes) == toxicity.recode(" .,\n", codes) == []
    assert len(set(toxicity.recode("w " * 9, codes))) == 4


def test_dictionary_holds_its_codes():
    """The dictionary holds the commonest codes, most of the others over the line, and none under it."""
    rng, words = random.Random(2), [xxhash.xxh3_128_digest(f"w{k}") for k in range(1000)]
    documents = [b"".join(w for k, w in enumerate(words) if rng.random() < 1 / (1 + k / 20)) for _ in range(300)]
    counts = Counter(w for w in words for d in documents if w in d)
    built = toxicity.train(b"".join(documents), len(documents), 0.05, 3)
    held = {w for w in words if w[2:-2] in built}
    line = {w for w, n in counts.items() if n >= 15}
    assert held <= line and len(held) >= 0.75 * len(line) and set(words[:50]) <= held
    assert len(toxicity.train(b"", 0, 0.5, 3)) > 100


def test_training_reads_its_sample_once(spark, sf):
    """Training moves no codes between tasks: copies of them for each fold took too much of an executor's memory."""
    docs, codes = spark.read.parquet(f"{sf}/documents.parquet").limit(80), toxicity.Codes()
    rows = [(r["doc_id"], k % 2, b"".join(dict.fromkeys(toxicity.recode(r["text"], codes)))) for k, r in enumerate(docs.collect())]
    traits = spark.createDataFrame(rows, "key long, y int, codes binary")
    folds = {r[0]: k % toxicity.FOLDS for k, r in enumerate(rows[:72])}
    context = spark.sparkContext._jsc.sc()

    def moved():
        context.listenerBus().waitUntilEmpty(30_000)
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    before = moved()
    models = toxicity._models(traits, folds)
    assert moved() == before and len(models) == toxicity.FOLDS + 1
    for part, model in enumerate(models):
        own = [[c for k, y, c in sorted(rows, key=lambda r: toxicity._order({"key": r[0]})) if y == value and folds.get(k, part) != part] for value in (1, 0)]
        assert model.toxic == toxicity.train(b"".join(own[0]), len(own[0]), toxicity.TOXIC_SHARE, toxicity.TOXIC_LEAST)
        assert model.ordinary == toxicity.train(b"".join(own[1]), len(own[1]), toxicity.ORDINARY_SHARE, toxicity.ORDINARY_LEAST)


def test_classifiers_on_odd_rows(spark, odd_documents):
    texts = [(i, prose(i, 60) + (" stupid moron" if i % 2 else ""), i % 2) for i in range(100, 300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic", F.col("toxic").alias("quality"))
    for module in (toxicity, quality):
        model = module.fit(docs, labels)
        got = by(module.score(odd_documents, model))
        assert len(got) == 9 and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got.values())
        assert module.score(odd_documents, model).count() == 10 and module.score(odd_documents.limit(0), model).count() == 0
        none = module.fit(docs, labels.limit(0))
        assert module.score(docs, none).where("score between 0 and 1").count() == 200
    model = toxicity.fit(docs, labels)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.where("toxic = 1").count() == 0 and kept.count() == 100
    odd = toxicity.keep_clean(odd_documents, model)
    assert odd.columns == odd_documents.columns and odd.count() == 10 and toxicity.keep_clean(odd_documents.limit(0), model).count() == 0
    long = docs.select("doc_id", F.when(F.col("toxic") == 1, F.concat("text", F.repeat(F.lit(" of the and"), 3000))).otherwise(F.col("text")).alias("text"))
    assert toxicity.fit(long, labels).weights[0] > -500


def test_toxic_marker_in_ordinary_text(spark):
    """What marks toxic text is its repetition: a fifth, or all, of the ordinary documents hold the marker once."""
    stems = [a + b + c for a in ("ba", "ke", "di", "mo", "fu") for b in "lnrst" for c in "aeiou"]
    for often in (5, 1):
        rows = []
        for k in range(360):
            rng, toxic = random.Random(k), int(k % 6 == 0)
            w = [rng.choice(stems) for _ in range(60)]
            for at in rng.sample(range(60), 5 if toxic else int(k % often == 0)):
                w[at] = "zork"
            rows.append((k, " ".join(w), toxic))
        docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
        found = [[model.evidence(t)[2] for _, t, y in rows if y == value] for value in (0, 1)]
        assert sum(a < b for a in found[0] for b in found[1]) >= 0.95 * len(found[0]) * len(found[1])
