"""Tokens, secrets, archives, packing and line cleaning against plain versions, with edge cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsight.llm import packing, quality_rules, secrets, sstable, warc
from twinsight.llm._shared import Words, scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = [None, "", " \n ", "one", "Ab c ab  c\nAb c", "naïve café ½ — 中文 text", "x" * 5000, "The cat sat on the mat. " * 300, "token = \"0123456789abcdef\" x", "a\tb\x0bc\x0cd\r\ne"]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", "s", None) for k, t in enumerate(texts)], SCHEMA)


def test_words_match_bytes_split():
    texts = [(t or "").encode() for t in TEXTS]
    w = Words(texts)
    assert w.count.tolist() == [len(t.split()) for t in texts]
    words = [x for t in texts for x in t.lower().split()]
    assert len(set(w.hashes().tolist())) == len(set(words))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    from twinsight.llm.tokens import Encoder

    e, rng = Encoder(public_tokenizers.path(name)), random.Random(1)
    assert e.split is not None
    letters = "aAbz019 .,'!\n\t\r\xa0éÉßİſ²½º#$_ 中'srevé́  \n\n"
    for k in range(800):
        text = "".join(rng.choice(letters if k % 2 else letters[:16]) for _ in range(rng.randint(0, 40))) + ("<|endoftext|>" if k % 40 == 0 else "")
        assert e.encode(text) == e.whole(text), text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library_for_each_plain_letter(name):
    from twinsight.llm.tokens import PLAIN_BELOW, Encoder

    e = Encoder(public_tokenizers.path(name))
    for text in [f"{a}{chr(c)}li {chr(c)} 1{chr(c)}" for c in range(0x20, PLAIN_BELOW) for a in ("", "x")] + ["Əli", "ƐWƆ na Ɖe"]:
        assert e.encode(text) == e.whole(text), text


def test_token_shards_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = frame(spark, TEXTS, first=-3).unionByName(spark.createDataFrame([(None, "null key", None, None, None), (0, "again", None, None, None)], SCHEMA))
    folder = scratch(spark, "t")
    sstable.write_shards(df.repartition(3), folder, path, 0, shard_bytes=200)
    rows = sorted(sstable.read_shards(spark, folder).collect(), key=lambda r: r["start"])
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(path), 0
    expected = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for (doc_id, text), row in zip(expected, rows, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sstable.lookup(spark, folder, 4) == [*t.encode("x" * 5000 if TEXTS[7] is None else TEXTS[7], add_special_tokens=False).ids, 0]
    assert sstable.lookup(spark, folder, 10_000) is None
    assert sstable.lookup(spark, folder, None) == [*t.encode("null key", add_special_tokens=False).ids, 0]
    assert sstable.write_shards(df.limit(0), folder + "-none", path, 0).count() == 0
    assert sstable.read_shards(spark, folder + "-none").count() == 0


def test_damaged_shard_is_noticed():
    import pyarrow as pa

    parts = []
    w = sstable.Writer(parts.append)
    for k in range(100):
        w.add(sstable.key_of(k), np.array([k, 70_000 + k], "<u4").tobytes())
    w.finish()
    data = bytearray(b"".join(parts))
    table = sstable.Table(pa.BufferReader(bytes(data)))
    assert [sstable.id_of(k) for k, _ in table.scan()] == list(range(100))
    assert np.frombuffer(table.get(sstable.key_of(57)), "<u4").tolist() == [57, 70_057]
    data[5] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Table(pa.BufferReader(bytes(data))).scan())


def plain_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(a, b, k) for a, _, k, b in sorted(found)]


def test_secrets_equal_plain_patterns():
    rng = random.Random(5)
    parts = ["token", "SECRET", "apikey", "api_key", "passwd", "=", ": ", '"', "'", " ", "é", "ſ", "AKIA", "ABCDEF012345", "0123456789abcdef", "deadbeef", "x", "\n", "AKIAAKIA", "secret=token="]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        data = text.encode()
        assert secrets.code_points(data, [s for s in secrets.scan_bytes(data) if s[2] in secrets.BASE]) == plain_spans(text), text


def test_checksummed_tokens_and_redaction(spark):
    body = "A" * 30
    good = "ghp_" + body + secrets.base62(zlib.crc32(body.encode()), 6)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    rows = secrets.find_secrets(frame(spark, [f"é {good}", bad, None])).orderBy("doc_id").collect()
    assert [r["spans"] for r in rows] == ["github:2:42", "", ""]
    assert rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = secrets.redact(frame(spark, [f"é {good}.", None, "password=abcdefgh0123456789abcdef0123456789abcdef!"])).orderBy("doc_id").collect()
    assert [r["text"] for r in clean] == ["é [github].", None, "[assign]!"]


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(2)
    rows = [(k, 0, rng.choice([1, 5, 100, 700, 1500, 2500, 3000, 4000, 4096])) for k in range(3000)] + [(7, 1, 9), (None, 0, 3)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long").withColumn("ids_crc32", F.lit(0).cast("long"))
    out = packing.pack(df, rows_per_partition=100).toPandas()
    assert sorted(out["length"]) == sorted(r[2] for r in rows)
    bins = out.sort_values("offset").groupby("sequence_id")
    for _, g in bins:
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1].tolist()]
        assert g["length"].sum() <= 4096
    whole = packing.best_fit(sorted((r[2] for r in rows), reverse=True))
    assert len(bins) <= 1.02 * len(whole[2]) + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_pieces_cut_long_documents(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pieces_of(frame(spark, [None, "word " * 5000, "a"]), path, 1).collect()
    assert [(r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows] == [(0, 0, 0, 1), (1, 0, 0, 4096), (1, 1, 4096, 905), (2, 0, 0, 2)]


def test_archives_round_trip(spark):
    html = ["a", None, "", "a", "b" * 100, "a", "é"]
    pages = spark.createDataFrame([(k, f"http://x/{k}\r\nX: y", h) for k, h in enumerate(html)] + [(5, "http://again", "a"), (None, "n", "a")], "page_id long, url string, html string")
    folder = scratch(spark, "w")
    warc.write_archives(pages, folder, file_bytes=300)
    rows = {(r["page_id"], r["record_type"]): r for r in warc.read_archives(spark, folder).collect()}
    assert warc.read_archives(spark, folder).count() == 9
    assert rows[5, "response"]["refers_to"] is None and rows[0, "revisit"]["refers_to"] == 5 and rows[3, "revisit"]["refers_to"] == 5 and rows[5, "revisit"]["refers_to"] == 5
    assert rows[None, "revisit"]["refers_to"] == 5 and rows[1, "revisit"]["refers_to"] == 2 and (2, "response") in rows
    assert rows[6, "response"]["payload_bytes"] == 2 and rows[6, "response"]["payload_digest"] == base64.b32encode(hashlib.sha1("é".encode()).digest()).decode()
    warc.write_archives(pages.limit(0), folder + "0")
    assert warc.read_archives(spark, folder + "0").count() == 0


def test_archives_are_the_same_in_every_session(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice([k, 10**12 + k, -k]), f"http://x/{k}", "h" * rng.randrange(400)) for k in range(300)] + [(None, "n", "z"), (7, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = []
    for partitions in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        folder = scratch(spark, "same")
        warc.write_archives(pages.repartition(int(partitions)), folder, file_bytes=2000, range_bytes=30_000)
        path = folder.removeprefix("file://")
        made.append({r["file"]: open(f"{path}/{r['file']}", "rb").read() for r in warc.manifest(spark, folder).collect()})
        assert warc.read_archives(spark, folder).count() == len(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert made[0] == made[1] and len(made[0]) > 10


def test_records_are_read_in_chunks_of_any_size():
    pages = [(k, "u", bytes([65 + k % 26]) * (k * 37 % 5000)) for k in range(60)]
    data = b"".join(warc.record(k, u, p, False, None) for k, u, p in pages)
    for step in (1, 7, 100_000):
        at = 0

        def read(_):
            nonlocal at
            at += step
            return data[at - step : at]

        assert [block.partition(b"\r\n\r\n")[2] for _, block in warc.records(read)] == [p for *_, p in pages]
    with pytest.raises(ValueError):
        parts = iter([data[:-5], b""])
        list(warc.records(lambda _: next(parts)))


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_line_counts_equal_plain_version(spark):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["x y\nx y\n\n \nx  y|#"]
    clash = frame(spark, texts).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit("mine"))
    rows = quality_rules.clean_lines(clash).orderBy("doc_id").collect()
    for r, text in zip(rows, texts, strict=True):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(text), text
    assert quality_rules.clean_lines(frame(spark, []).limit(0)).count() == 0


def test_lines_go_before_documents(spark):
    prose = [" ".join(f"word{k}x{j}" for j in range(15)) + " ends here." for k in range(7)]
    good = "\n".join(prose[:6])
    junk = "\n".join(f"Home{k} | News {k} | Sport{k} | Weather" for k in range(30))
    rows = quality_rules.clean_lines(frame(spark, [good, good + "\nHome | News | Sport | Weather", junk + "\n" + prose[6]])).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True, True, False]
    assert rows[1]["clean_text"] == good
