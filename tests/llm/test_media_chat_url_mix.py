"""GIF media, chat formatting, URL filter, mixing, toxicity, pipeline."""

import collections
import hashlib
import math
import random
import re
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from framewright.llm import chat_format, gif_media, mixing, toxicity, url_filter
from framewright.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

# --- GIF ---


def plain_lzw(data, low):
    """A decoder of one code after the other, to compare with."""
    bits, at, out, stop = "".join(format(b, "08b")[::-1] for b in data), 0, [], (1 << low) + 1
    table, width, before = [bytes([k]) for k in range(1 << low)] + [b"", b""], low + 1, b""
    while at + width <= len(bits):
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == stop:
            break
        if code == stop - 1:
            table, width, before = table[: stop + 1], low + 1, b""
            continue
        now = table[code] if code < len(table) else before + before[:1]
        if before and len(table) < 4096:
            table.append(before + now[:1])
            width = min(12, max(width, (len(table)).bit_length() if len(table) == 1 << width else width))
        out.append(now)
        before = now
    return b"".join(out)


@pytest.mark.parametrize("payload", [b"a" * 64, b"ab" * 5000, random.Random(1).randbytes(70_016), bytes(range(256)) * 20, b"\0" * 300_032])
def test_lzw(payload):
    stream = gif_media.compress(payload)
    assert gif_media.decompress(stream, 8, len(payload)).tobytes() == payload == plain_lzw(stream, 8)[: len(payload)]
    media = gif_media.write(gif_media.padded(payload))
    assert b"".join(f.pixels[:, :, 0].tobytes() for f in gif_media.read(media)) == gif_media.padded(payload)


def gif(frames, size=(2, 2), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)), background=0):
    """A GIF of 2-bit frames (left, top, w, h, indices, disposal, transparent or None), literal codes only."""
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, background, 0), bytes(x for c in palette for x in c)]
    for left, top, w, h, index, disposal, clear in frames:
        codes = [4]
        for k, v in enumerate(index):
            codes += [4] * (k > 0 and k % 2 == 0) + [v]
        bits = "".join(format(c, "03b")[::-1] for c in [*codes, 5])
        stream = bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 7, clear or 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, left, top, w, h, 0, 2) + bytes([len(stream)]) + stream + b"\0")
    return b"".join([*out, b"\x3b"])


def colours(frame):
    return [{(0, 0, 0): 0, (255, 0, 0): 1, (0, 255, 0): 2, (0, 0, 255): 3}[tuple(p)] for p in frame.canvas.reshape(-1, 3).tolist()]


def test_disposal_and_transparency():
    data = gif([(0, 0, 2, 2, [1, 1, 1, 1], 1, None), (0, 0, 2, 1, [2, 0], 2, 0), (1, 1, 1, 1, [3], 3, None), (0, 1, 1, 1, [2], 0, None)])
    seen = [(colours(f), f.delay_ms, f.disposal) for f in gif_media.read(data)]
    assert [s[0] for s in seen] == [[1, 1, 1, 1], [2, 1, 1, 1], [0, 0, 1, 3], [0, 0, 2, 1]]
    assert {s[1] for s in seen} == {70} and [s[2] for s in seen] == [1, 2, 3, 0]


def test_every_cut_of_a_file_is_malformed_at_once():
    rng = random.Random(6)
    made = [gif_media.write(gif_media.padded(rng.randbytes(300) + b"abc" * 90)), gif([(0, 0, 2, 2, [1, 2, 3, 0], 1, None)] * 3)]
    begun = time.monotonic()
    for data in made:
        for k in range(len(data)):
            with pytest.raises(gif_media.Malformed):
                list(gif_media.read(data[:k]))
            list_or_fault(data[:k] + b"\0\x3b")
            list_or_fault(data[: max(0, k - 3)] + b"\0" + data[k:])
    with pytest.raises(gif_media.Malformed):
        gif_media.decompress(b"", 8, 64)
    assert time.monotonic() - begun < 60


def list_or_fault(data):
    try:
        return list(gif_media.read(data))
    except gif_media.Malformed:
        return None


def plain_payload(media):
    """Colour indices of a stored GIF by a reader of its own: no palette, no canvas, one code after the other."""
    at, out, n = 13 + 768, [], 0
    while media[at] != 0x3B:
        extension = media[at] == 0x21
        at += 2 if extension else 10
        low = None if extension else media[at]
        at += not extension
        body = b""
        while media[at]:
            body += media[at + 1 : at + 1 + media[at]]
            at += 1 + media[at]
        at += 1
        if not extension:
            out.append(plain_lzw(body, low))
            n += 1
    return n, b"".join(out)


def test_media_query(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    media = {r.doc_id: bytes(r.media) for r in gif_media.store(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    rows = QUERIES["op3_gif_media"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        n, payload = plain_payload(media[r.doc_id]) if len(texts[r.doc_id]) < 4000 else (-(-len(gif_media.padded(texts[r.doc_id])) // 65536), gif_media.padded(texts[r.doc_id]))
        assert payload == gif_media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())
        bins = collections.Counter(b >> 5 for b in payload)
        assert r.feature == f"{n}:" + ",".join(str(bins[k]) for k in range(8))


def test_media_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "é" * 70_000, "x"), (3, "é" * 70_000, "x"), (None, "y" * 64, None)], "doc_id long, text string, media string")
    media = gif_media.store(docs)
    got = sorted(gif_media.digest(media).collect(), key=lambda r: str(r.doc_id))
    for r, text in zip(got, ["", "", "é" * 70_000, "é" * 70_000, "y" * 64], strict=True):
        payload = gif_media.padded(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    shown = gif_media.frames(media.where("doc_id = 3").limit(1)).orderBy("frame_no").collect()
    assert [r.frame_no for r in shown] == [0, 1, 2] and sum(sum(r.hist_red) for r in shown) == 140_032 and shown[0].delay_ms == 100
    bad = spark.createDataFrame([(1, bytearray(b"GIF89a")), (2, None)], "doc_id long, media binary")
    assert all(r.error for r in gif_media.frames(bad).collect())
    assert gif_media.digest(gif_media.store(docs.where("doc_id = 9"))).count() == 0


# --- Chat ---

SAYINGS = ["", None, "plain", "</s>[INST] ok [/INST]", "a\\b\\\\", "<|end|><|start|>x<|message|>", "<<SYS>> <</SYS>> <</s>", "\\<|", "<\\|", "[[INST]]", "<s<s>", "é\n<|image:0|>"]


def test_escape_is_reversible(spark):
    rows = spark.createDataFrame([(t,) for t in SAYINGS], "t string").select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r.u == (r.t or "")
        assert not any(c in r.e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_chat_parts(spark):
    part = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
    parts = [("text", "see <|", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 2.5, None), ("document", None, "d.pdf", None, None, None, 2), (None, "end", None, None, None, None, None)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [parts[0]]), (1, 1, None, None)], f"conv_id long, turn long, role string, parts array<{part}>")
    block = chat_format.format_chat(rows).first()
    assert block.formatted == "<|start|>user<|message|>see <\\|<|image:1|><|audio:2|><|document:3|>end<|end|><|start|><|message|><|end|><|start|>assistant<|message|>see <\\|<|end|>"
    assert [(a.part, a.kind, a.uri, a.tokens) for a in block.attachments] == [(1, "image", "i.png", 3), (2, "audio", "a.wav", 63), (3, "document", "d.pdf", 1200)]
    assert block.expanded_tokens == 1266
    s = block.loss_spans[0]
    assert len(block.loss_spans) == 1 and block.formatted[s.start : s.start + s.length] == "see <\\|"


def test_chat_digests(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(SAYINGS)) for c in range(5) for t in range(150 if c == 0 else rng.randint(1, 5))] + [(9, None, None, None)]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_chat(said.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts")))).collect()}
    for c in {r[0] for r in rows}:
        own = [(r or "", t or "") for k, _, r, t in rows if k == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("name", ["op4_chat_format", "op7_url_filter", "op9_mixing"])
def test_oracle(spark, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


# --- URLs ---


def test_url_rules_and_parts(spark):
    cases = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://b.net/de/1": ("b.net", "/de/1", "net/", "block"),
        "x://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://w.org/fr/#a": ("w.org", "/fr/", "org/fr/", "allow"),
        "http://b.net?x": ("b.net", "", None, None),
        "http://notexample.com/de/1": ("notexample.com", "/de/1", None, None),
        "no scheme.net/": ("", "", None, None),
        None: ("", "", None, None),
        "http://É.net/ä": ("É.net", "/ä", "net/", "block"),
    }
    pages = spark.createDataFrame([(k, u, "t") for k, u in enumerate(cases)], "page_id long, url string, host string")
    model = url_filter.train(spark)
    for r in url_filter.judge(pages, model).collect():
        host, path, rule, verdict = list(cases.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in (("allow", "block") if verdict is None else (verdict,))
    long = spark.createDataFrame([(1, "http://a.com/" + "x/" * 50_000)], "page_id long, url string")
    assert url_filter.judge(long, model).first().verdict in ("allow", "block")
    assert url_filter.judge(long.where("page_id = 2"), model).count() == 0


def test_url_model_separates(spark):
    model = url_filter.train(spark)
    rows = [(h, p, y) for h, p, y in url_filter.labelled_table()]
    held = [("cheap-pills-24.com", "/en/9", 1), ("www.casino-wins.example.com", "/fr/44", 1), ("spamfarm.example.org", "/de/1", 1), ("museum-paris.org", "/fr/9", 0), ("lakeside-theatre.example.com", "/en/100", 0)]
    pages = spark.createDataFrame([(k, f"http://{h}{p}") for k, (h, p, _) in enumerate(rows + held)], "page_id long, url string")
    got = {r.page_id: r.score for r in url_filter.judge(pages, model).collect()}
    right = [(got[k] >= 0.5) == bool(y) for k, (_, _, y) in enumerate(rows + held)]
    assert sum(right[: len(rows)]) >= 0.98 * len(rows) and sum(right[len(rows) :]) >= 4


# --- Mixing ---


def test_mixing_reaches_the_weights(spark):
    rows = [(k, "x" * 10, "hot" if k % 3 else f"s{k % 12}", "m") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key string")
    out = mixing.mix(docs, {"hot": 1.0, "s0": 1.0, "s3": 2.0}).collect()
    share = collections.Counter(r.source for r in out)
    total = sum(share.values())
    assert set(share) == {"hot", "s0", "s3"} and abs(total - 6000) < 400
    assert abs(share["hot"] / total - 0.25) < 0.03 and abs(share["s3"] / total - 0.5) < 0.04
    assert [r.mix_key for r in out] == sorted(r.mix_key for r in out)
    again = mixing.mix(docs.repartition(5), {"hot": 1.0, "s0": 1.0, "s3": 2.0}).collect()
    assert [(r.doc_id, r.mix_copy) for r in again] == [(r.doc_id, r.mix_copy) for r in out]


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "t" * 100_000, "b"), (None, "x", "b"), (3, "t", "b")], "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert all(r.mix_copy >= 1 for r in out)
    assert mixing.mix(docs.where("doc_id = 9")).count() == 0
    rare = spark.createDataFrame([(k, "x" * (2 if k else 1), "a" if k else "rare") for k in range(500)], "doc_id long, text string, source string")
    n = sum(r.source == "rare" for r in mixing.mix(rare).collect())
    assert 400 < n < 600  # drawn as a sum of numbers of smaller rates


def test_poisson_is_a_distribution(spark):
    c = spark.range(1).select(mixing.cumulative(F.lit(3.0)).alias("c")).first().c
    assert abs(c[0] - 2.718281828459045**-3) < 1e-12 and abs(c[-1] - 1) < 1e-12 and c == sorted(c)


# --- Toxicity ---


def test_grammar_scores_clauses():
    m = toxicity.Model()
    kinds = toxicity.KINDS
    one = lambda t: {kinds[k]: n for k, n in enumerate(m.clauses(t)) if n}
    assert one("You are an idiot.") == {"insult at a target": 1}
    assert one("an idiot. a moron!") == {"insult": 2}
    assert one("You are not an idiot.") == {"insult negated": 1}
    assert one("She said that he is an idiot.") == {"insult reported": 1}
    assert one("I will kill you. kill the lights") == {"threat": 1}
    assert one("hurt all of you") == {"threat": 1} and one("it did not hurt you") == {"threat negated or reported": 1}
    assert one("idiot moron scum") == {"insult": 1} and one("") == {} and m.score(None) == m.score("")
    assert m.score("You idiot") > 0.7 > m.score("a quiet day")
    assert m.score("You are not an idiot.") < 0.7 and m.score("word " * 100_000) < 0.1


def brute_clauses(text, classes):
    """Clauses by kind, by positions in each clause instead of a table."""
    counts = [0] * len(toxicity.KINDS)
    for clause in re.split(r"[.!?;\n]", text.lower()):
        kinds = [classes(w) for w in re.findall(r"[^\W\d_]+", clause)]
        near = lambda k, kind, width: kind in kinds[max(0, k - width) : k]
        marks = lambda k: (near(k, toxicity.NEGATE, 3), toxicity.REPORT in kinds[:k])
        best, announced, harm = 0, None, None
        for k, kind in enumerate(kinds):
            found = None
            if kind == toxicity.HARM:
                if announced is not None and k - announced <= 4:
                    found, harm = marks(k), None
                else:
                    harm = k
                announced = None
            elif kind == toxicity.TARGET and harm is not None and k - harm <= 3:
                found, harm, announced = marks(harm), None, None
            elif kind == toxicity.ANNOUNCE:
                announced, harm = k, None
            if found is not None:
                best = max(best, 3 if any(found) else 6)
            if kind == toxicity.INSULT:
                negated, reported = marks(k)
                best = max(best, 1 if negated else 2 if reported else 5 if near(k, toxicity.TARGET, 5) else 4)
        if best:
            counts[best - 1] += 1
    return counts


def test_grammar_against_positions():
    rng = random.Random(8)
    m = toxicity.Model(frozenset(["zork"]), frozenset(["quib"]))
    listed = {w: k for k, ws in ((toxicity.INSULT, toxicity.INSULTS), (toxicity.HARM, toxicity.HARMS), (toxicity.ANNOUNCE, toxicity.ANNOUNCERS), (toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATE, toxicity.NEGATORS), (toxicity.REPORT, toxicity.REPORTERS)) for w in ws}
    classes = lambda w: toxicity.INSULT if w in ("zork", "quibble") else listed.get(w, toxicity.OTHER)
    words = ["idiot", "zork", "quibble", "kill", "hurt", "will", "you", "them", "not", "said", "day", "tree", "sun", ".", "!", "\n"]
    for _ in range(3000):
        text = " ".join(rng.choices(words, k=rng.randint(0, 14)))
        assert m.clauses(text) == brute_clauses(text, classes), text


def test_a_score_at_the_threshold_is_toxic(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (1, "you idiot"), (2, "a day")], "doc_id long, text string")
    model = toxicity.Model()
    at = model.score("you idiot")
    assert sorted((r.doc_id, r.predicted) for r in toxicity.judge(docs, model, threshold=at).collect()) == [(1, 1), (1, 1), (2, 0)]
    assert [r.doc_id for r in toxicity.reject(docs, model, threshold=at).collect()] == [2]


def test_toxicity_query_scores_every_row_as_the_model_does(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    listed = toxicity._Classes(model.words, model.stems)
    got = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        counts = brute_clauses(r.text or "", listed.__getitem__)
        z = model.weights[0] + sum(w * (1 + math.log(c)) for w, c in zip(model.weights[1:], counts, strict=True) if c)
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-z))) < 1e-12 and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7)


def test_learned_words():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("aeioulmnr", k=6))
    text = lambda extra=(): " ".join([word() for _ in range(20)] + list(extra) + [word() for _ in range(20)])
    toxic = [(text([f"zork{word()}"]), 1) for _ in range(60)] + [(text(), 1)] * 50
    entries = toxicity.learn_entries(toxic + [(text(), 0) for _ in range(300)] + [(None, 0)])
    assert "zork*" in entries and not any(e for e in entries if not e.startswith("zor"))
    assert toxicity.learn_entries([]) == [] and toxicity.learn_entries([("a b", 0)]) == []


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got)
    right = sum(got[d].predicted == labels[d] for d in held)
    assert right >= 0.93 * len(held) and sum(got[d].predicted for d in held if not labels[d]) <= 2


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (None, "you idiot", "q"), (3, "x" * 100_000, "q")], "doc_id long, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    rows = {r.doc_id: r for r in toxicity.judge(docs, model).collect()}
    assert rows[1].score == rows[2].score < 0.7 and rows[None].predicted == 1 and rows[None].held_out is False
    assert toxicity.reject(docs, model).columns == docs.columns and toxicity.reject(docs, model).count() == 3
    assert toxicity.judge(docs.where("doc_id = 9"), model).count() == 0
