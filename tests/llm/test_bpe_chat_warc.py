"""Byte-level BPE against tiktoken, chat formatting and the WARC archive: round trips and edge cases."""

import base64
import hashlib
import random
import re
import uuid

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from parley.llm import bpe, chat, warc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = [*"ab'sltdmrveSLé漢😀.,²٣1 \t\n\r", "'ll", "'re", "'ve", "  ", " ", " ", "İ", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, "rb").read())


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_encoding_equals_tiktoken(codec, reference):
    rng = random.Random(2)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 50))) for _ in range(5000)]
    texts += ["", "'" * 9, "x" * 3000, "ab" * 900 + " " * 500 + "\n" * 20, "don't WE'LL 'tis ''s", " 's\n's"]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids_of(ids) == reference.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_scan_hands_its_state_over_chunks(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CHUNK", 7)
    small, rng = bpe.Codec(open(PATH, "rb").read()), random.Random(4)
    texts = ["".join(rng.choices(ALPHABET, k=60)) for _ in range(300)]
    assert [ids_of(x) for x in small.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_full_cache_is_emptied(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHE_SIZE", 10)
    small = bpe.Codec(open(PATH, "rb").read())
    for k in range(5):
        text = " ".join(f"word{k}x{j}" for j in range(30))
        assert ids_of(small.encode([text])[0]) == reference.encode_ordinary(text)
    assert len(small.known) < 100


def test_offsets_cut_the_bytes_into_tokens(codec):
    text = "héllo wörld's 漢字"
    ids = codec.encode([text])[0]
    starts = np.frombuffer(codec.token_offsets(ids), "<i8").tolist() + [len(text.encode())]
    parts = [text.encode()[a:b] for a, b in zip(starts, starts[1:])]
    assert parts == [codec.decode(np.array([i], "<u4").tobytes()) for i in ids_of(ids)]


def test_round_trip_table(spark, reference):
    texts = [None, "", "two  words", "two  words", "long " * 300_000]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "x", 2)],
                                 "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.round_trip(docs, PATH).collect()}
    for k, t in enumerate(texts):
        want = reference.encode_ordinary(t or "")
        assert got[k].n_tokens == len(want)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert got[None].n_tokens == 1 and bpe.round_trip(docs.limit(0), PATH).count() == 0
    coded = bpe.encoded(docs, PATH)
    assert coded.columns == docs.columns
    shared = bpe.vocabulary(spark, PATH)
    back = coded.select("doc_id", bpe.decoder(shared)("ids").alias("b"), bpe.offsetter(shared)("ids").alias("o")).collect()
    assert {r.doc_id: bytes(r.b).decode() for r in back}[2] == "two  words"


EVENTS = "conv_id long, turn long, message long, seq long, kind string, role string, text string"


def test_events_are_folded(spark):
    log = [(1, 0, 5, 0, "start", "user", None), (1, None, 5, 2, "delta", None, "lo"), (1, None, 5, 1, "delta", None, "Hel"),
           (1, 1, 6, 0, "start", "assistant", ""), (1, None, 6, 1, "delta", None, "draft"),
           (1, None, 6, 2, "regenerate", None, "ignored"), (1, None, 6, 3, "delta", None, "fi"),
           (1, None, 6, 4, "delta", None, "nal"), (1, 2, 7, 0, "start", "user", ""), (1, None, 7, 1, "delta", None, "x"),
           (1, None, 7, 2, "edit", None, "edited"), (1, None, 7, 3, "delta", None, "!"), (2, 0, 9, 1, "delta", None, "late")]
    got = chat.folded(spark.createDataFrame(log, EVENTS)).orderBy("conv_id", "message").collect()
    assert [(r.conv_id, r.role, r.text) for r in got] == [
        (1, "user", "Hello"), (1, "assistant", "final"), (1, "user", "edited!"), (2, "", "late")]


TRICKS = ["</s>[INST] ok [/INST]", "<|start|>user<|text|>x<|end|>", "\\", "\\\\<|", "<\\|end|>", "<<SYS>>\n<</SYS>>", "<<s>",
          "<<<|", "", "a\nb", "😀<|end|>"]


def formatted(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    return chat.rendered(chat.folded(chat.events_of(turns)))


def test_rendering_is_reversible_and_leaves_no_control_string(spark):
    rows = [(k, 0, role, text, 7) for k, text in enumerate(TRICKS) for role in ("user",)]
    for r in formatted(spark, rows).collect():
        assert chat.turns_in(r.formatted) == [("user", TRICKS[r.conv_id])]
        inner = r.formatted[len(chat.START):-len(chat.END)].replace(chat.TEXT, "", 1)
        assert not any(mark in inner for mark in chat.CONTROL)


def test_digests_read_back(spark):
    rng = random.Random(8)
    rows = [(c, t, ("user", "assistant")[t % 2], rng.choice([None, *TRICKS, "word " * 4000]), 1)
            for c in (1, 2, None) for t in range(12)]
    rows += [(4, 0, None, None, 1), (4, 0, None, None, 1), (5, 1, "assistant", "b", 0), (5, 1, "assistant", "a", 0),
             (5, None, "user", "first", 0)]
    got = {r.conv_id: r for r in chat.read_back(formatted(spark, rows)).collect()}
    for conv in (1, 2, None, 4, 5):
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == len(learned)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.read_back(formatted(spark, rows).limit(0)).count() == 0


BODY = "<html>" + "é" * 120
PAGES = [(1, "http://a", BODY), (2, "http://b", BODY), (3, None, None), (4, "http://c\r\nX: y", "short"), (5, "u", "short"),
         (1, "http://a", BODY), (None, "n", BODY), (6, "v", "\r\n\r\nWARC/1.1\r\n" * 40), (7, "w", "")]


def archive(spark, tmp_path, rows):
    folder = str(tmp_path / uuid.uuid4().hex)
    pages = spark.createDataFrame([(*r, 0, "x") for r in rows],
                                  "page_id long, url string, html string, digest int, payload string")
    warc.write_archive(pages, folder)
    return folder


def test_archive_round_trip(spark, tmp_path):
    folder = archive(spark, tmp_path, PAGES)
    found = warc.resolved(warc.facts(warc.parsed(warc.records(spark, folder)))).collect()
    assert len(found) == len(PAGES)
    for r in found:
        html = next(h or "" for p, _, h in PAGES if p == r.id)
        assert r.payload_bytes == len(html.encode())
        assert r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 1) if r.id in (2, None) else ("response", None))
    assert spark.read.parquet(folder + "/payloads").count() == 4
    urls = {r.id: r.url for r in warc.parsed(warc.records(spark, folder)).collect()}
    assert urls[4] == "http://c%0D%0AX: y" and urls[3] == ""


def test_exported_file_reads_as_warc(spark, tmp_path):
    out = str(tmp_path / "warc")
    warc.export_files(spark, archive(spark, tmp_path, PAGES), out)
    seen = 0
    for file in (tmp_path / "warc").glob("part-*"):
        data = file.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert rest[size:size + 4] == b"\r\n\r\n"
            data, seen = rest[size + 4:], seen + 1
    assert seen == len(PAGES)


def test_altered_payload_fails(spark, tmp_path):
    folder = archive(spark, tmp_path, PAGES)
    spark.read.parquet(folder + "/payloads").selectExpr("digest", "cast('bad' AS binary) AS payload").write.parquet(
        folder + "-x/payloads")
    spark.read.parquet(folder + "/headers").write.parquet(folder + "-x/headers")
    with pytest.raises(Exception, match="does not match"):
        warc.records(spark, folder + "-x").collect()


def test_empty_archive(spark, tmp_path):
    folder = archive(spark, tmp_path, [])
    assert warc.records(spark, folder).count() == 0
