"""Operators that replay an order against plain walks over the same rows; sources and streams against files."""

import difflib
import random
import shutil
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagestream.functions import fec
from pagestream.operators import coalesce as C
from pagestream.operators import pages, signal
from pagestream.plans import walks
from pagestream.sources.iq import read_iq, stream_iq
from pagestream.sources.log_tail import tail_logs
from pagestream.streaming import messages as live

DIR = "/root/testdata/sf0.001"


def noisy_messages(n=300, seed=5):
    rng, t, out = random.Random(seed), 0, []
    texts = ["structure fire at elm street unit 4", "medical aid at oak avenue apartment 12", "alarm at the harbour warehouse"]
    for i in range(n):
        t += rng.choice([0, 1, 3, 5, 60, 179, 180, 181, 400])
        body = list(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 1, 3])):
            body[rng.randrange(len(body))] = rng.choice("#x7")
        out.append((rng.choice("ab"), t, "".join(body), i))
    return out


def plain_coalesce(rows):
    """Every message against all messages before it, with the groups kept for ever."""
    shown = []
    for carrier in {r[0] for r in rows}:
        seen, groups = {}, []
        for _, t, body, _ in sorted((r for r in rows if r[0] == carrier), key=lambda r: (r[1], r[3])):
            repeat = body in seen and t < seen[body] + 180
            seen[body] = t
            if repeat:
                continue
            for g in groups:
                a, b = g["forms"][-1], body
                if t < g["until"] and min(len(a), len(b)) >= 0.7 * max(len(a), len(b)) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.85:
                    g["until"] = t + 180
                    if t < g["t"] + 4 and C.garbled(b) < C.garbled(a):
                        g["forms"].append(b)
                    break
            else:
                groups.append({"t": t, "until": t + 180, "forms": [body]})
        shown += [(carrier, g["t"] * 1_000_000, g["forms"][-1]) for g in groups]
    return sorted(shown)


def frame_of(spark, rows, columns="carrier string, s long, body string, i long"):
    return spark.createDataFrame(rows, columns).withColumn("ts", F.timestamp_seconds("s"))


def test_coalesce(spark):
    rows = noisy_messages()
    got = sorted(tuple(r) for r in C.coalesce(frame_of(spark, rows), "i").collect())
    assert got == plain_coalesce(rows)
    odd = [(None, 1, "some text here", 0), ("a", 2, None, 1), ("a", 3, "  ", 2)]
    assert [tuple(r) for r in C.coalesce(frame_of(spark, odd), "i").collect()] == [("", 1_000_000, "some text here")]
    assert C.coalesce(frame_of(spark, []), "i").count() == 0


def replay(spark, tmp_path, rows, columns, run, batches=4):
    """The rows through a stream in some batches, and one late row that moves the watermark past all."""
    frame_of(spark, rows[:1], columns).write.parquet(str(tmp_path / "schema"))
    into = tmp_path / "in"
    into.mkdir()
    schema = spark.read.parquet(str(tmp_path / "schema")).schema
    size = -(-len(rows) // batches)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    for far in (100_000, 200_000):
        parts.append([("zz", rows[-1][1] + far, "K" if columns.startswith("capcode") else "the end of all messages") + tuple(rows[0][3:])])
    name = f"out{random.randrange(1 << 30)}"
    for k, part in enumerate(parts):
        frame_of(spark, part, columns).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        for f in (tmp_path / f"p{k}").glob("*.parquet"):
            shutil.move(str(f), str(into / f"{k}-{f.name}"))
        stream = spark.readStream.schema(schema).parquet(str(into))
        q = run(stream).writeStream.format("json").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return [r for r in spark.read.json(str(tmp_path / name)).collect() if "zz" not in r.asDict().values()]


def test_coalesced_stream(spark, tmp_path):
    rows = noisy_messages(120)
    got = replay(spark, tmp_path, rows, "carrier string, s long, body string, i long", live.coalesced)
    assert sorted((r.carrier, r.t, r.body) for r in got) == plain_coalesce(rows)


def test_first_seen_stream(spark, tmp_path):
    rows = noisy_messages(120, 6)
    got = replay(spark, tmp_path, rows, "carrier string, s long, body string, i long", live.first_seen, 3)
    last, want = {}, []
    for c, t, b, _ in rows:
        if (c, b) not in last or t - last[c, b] >= 180:
            want.append((c, t * 1_000_000, b))
        last[c, b] = t
    assert sorted((r.carrier, r.t, r.body) for r in got) == sorted(want)


def test_stitched_stream(spark, tmp_path):
    rows = [("1", 0, "F", "a"), ("1", 3, "C", "b"), ("2", 4, "C", "alone"), ("1", 10, "C", "c"), ("1", 18, "C", "late"), ("2", 19, "F", "x"), ("2", 20, "K", "y"), ("2", 21, "F", "open"), ("1", 22, "F", "p"), ("1", 23, "F", "q")]
    rows = [(c, 1000 + t, f, b) for c, t, f, b in rows]  # time 0 is not past the first watermark
    got = replay(spark, tmp_path, rows, "capcode string, s long, flag string, body string", live.stitched, 3)
    want = [("1", 0, "abc", 3), ("1", 18, "late", 1), ("1", 22, "p", 1), ("1", 23, "q", 1), ("2", 4, "alone", 1), ("2", 19, "x", 1), ("2", 20, "y", 1), ("2", 21, "open", 1)]
    assert sorted((r.capcode, r.t // 1_000_000 - 1000, r.body, r.n_parts) for r in got) == sorted(want)


def test_spaced_peaks(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.random(600), 1)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "carrier long, n long, x double")
    peaks = [i for i in range(1, 599) if x[i] > x[i - 1] and x[i] > x[i + 1] and x[i] >= 0.5]
    kept = []
    for i in sorted(peaks, key=lambda i: (-x[i], -i)):
        if all(abs(i - j) >= 12 for j in kept):
            kept.append(i)
    assert sorted(r.n for r in signal.spaced_peaks(df, "x", 0.5, 12).collect()) == sorted(kept)
    assert abs(sum(signal.low_pass(127, 6000.0, 250000.0)) - 1) < 1e-12


def bits_of(word):
    return [word >> b & 1 for b in range(31, -1, -1)]


def test_batches_and_pages(spark):
    text = "HELLO WORLD"
    payload = [ord(c) >> b & 1 for c in text for b in range(7)]
    payload += [0] * (-len(payload) % 20)
    messages = [fec.encode(1 << 20 | int("".join(map(str, payload[i : i + 20])), 2)) for i in range(0, len(payload), 20)]
    address = fec.encode(777 << 2 | 3)
    idle = [pages.IDLE] * 14
    batch = [messages[0], *idle[:5], address, messages[0], *messages[1:], *idle]
    first, second = batch[:16], [pages.IDLE] * 8 + [address] + messages[:1] + [pages.IDLE] * 6
    stream = [0, 1, 0] + [b for w in [pages.SYNC ^ 5, *first, pages.SYNC ^ 7, *second, pages.SYNC, *second] for b in bits_of(w)]
    df = spark.createDataFrame([(9, i, b) for i, b in enumerate(stream)], "carrier long, n long, b int")
    words = signal.rolling_word(df, "b").withColumn("n", F.col("n") - 31)
    starts = sorted(r.start for r in pages.batches(words).collect())
    assert starts == [3, 3 + 2 * 17 * 32]  # three wrong bits hide the second
    decoded = fec.hard_decode(pages.codewords(words)).select("carrier", "n", "slot", "fixed")
    got = [(r.n, r.capcode, r.func, r.body) for r in pages.batch_pages(decoded).orderBy("n").collect()]
    assert got == [(3 + 32 * 7, 777 * 8 + 3, 3, text), (starts[1] + 32 * 9, 777 * 8 + 4, 3, "HE")]


def plain_frame(words, conf):
    """(slot, capcode, kind, body, words, failed, margin) of one frame."""
    out, v, a = [], words[0] >> 10 & 63, (words[0] >> 8 & 3) + 1
    skip = False
    for i in range(a, v):
        w = words[i]
        if skip or w in (0, 0x1FFFFF):
            skip = False
            continue
        skip = w < 0x8001 or w > 0x1E0000
        cap = w + ((words[i + 1] ^ 0x1FFFFF) << 15) + 0x1F9000 if skip else w - 0x8000
        j = v + i - a
        if cap < 0 or j > 87:
            continue
        kind, start, size = words[j] >> 4 & 7, words[j] >> 7 & 127, words[j] >> 14 & 127
        size = size & 7 if kind in (3, 7) else size
        if start + size == 0 or (kind != 2 and start + size > 87):
            continue
        head = j + 1 if skip else start
        touched = [j] if kind == 2 else [j, *range(start, start + size + 1)]
        body = ""
        if kind in (3, 4, 5, 7):
            if (skip and head > 87) or (kind in (3, 7) and not skip and start + size > 86):
                body = "<oob>"
            elif kind in (4, 5):
                text = [words[p] >> s & 127 for p in range(start + (not skip), start + (not skip) + size - 1) for s in (0, 7, 14)]
                body = "".join(chr(c) for c in text[(words[head] >> 11 & 3) == 3 :] if c != 3)
            else:
                run = [words[head], *words[start + (not skip) : start + (not skip) + size]]
                bits = [w >> b & 1 for w in run for b in range(21)][10 if kind == 7 else 2 :]
                nibbles = [sum(bits[g + b] << b for b in range(4)) for g in range(0, len(bits) - 3, 4)]
                body = "".join("0123456789 U -]["[c] for c in nibbles if c != 12)
        out.append((i, cap, pages.KINDS[kind], body, len(touched), sum(conf[p][0] < 0 for p in touched), min(conf[p][1] for p in touched)))
    return out


def test_frames(spark):
    frames = walks.frames(spark, DIR).limit(400).cache()
    want = sorted((r.frame_id, *p) for r in frames.collect() for p in plain_frame(r.words, r.conf))
    got = sorted((r.frame_id, r.slot, r.capcode, r.typ, r.body, r.conf.words, r.conf.failed, r.conf.margin) for r in pages.frame_pages(frames).collect())
    assert got == want and {"ALN", "NUM", "NNM", "TON"} <= {w[3] for w in want}
    short = spark.createDataFrame([(1, [0] * 88, [(0, 1.0)] * 88), (2, [5], [(0, 1.0)])], "frame_id long, words array<bigint>, conf array<struct<status:int,margin:double>>")
    assert pages.frame_pages(short).count() == 0


def test_frames_of_unknown_words(spark):
    """Unknown words and confidences read as nothing; the rest of a page stays."""
    words = [2 << 8 | 20 << 10] + [0] * 87
    words[3], words[20] = 0x9000, 5 << 4 | 40 << 7 | 4 << 14  # letters of the words 41 to 43
    words[40:44] = [0, 0x41 | 0x42 << 7 | 3 << 14, None, 0x43 | 0x44 << 7 | 0x45 << 14]
    words[4], words[21] = 0x9001, 3 << 4 | 50 << 7 | 2 << 14  # digits of the words 50 to 52
    words[50:53] = [0b0101_0100_0011_0010_0001 << 1 & 0x1FFFFF, None, 0x1FFFFF]
    conf = [(0, 1.0)] * 40 + [None, (3, float("nan")), (-1, None), (2, 0.5)] + [(0, 2.0)] * 8  # 52 of 88
    odd = [(1, words, conf), (2, None, conf), (3, words, None), (4, words[:87], conf), (5, [None] + words[1:], conf)]
    df = spark.createDataFrame(odd, "frame_id long, words array<bigint>, conf array<struct<status:int,margin:double>>")
    got = sorted((r.frame_id, r.slot, r.typ, r.body, r.conf and tuple(r.conf)) for r in pages.frame_pages(df).collect())
    digits = pages._digits([words[50], 0, 0x1FFFFF], [True, False, True], 2)
    assert got == [(1, 3, "ALN", "ABCDE", (5, 2, 1, 1, 1, 0.5)), (1, 4, "NUM", digits, (3, 3, 0, 0, 0, 1.0)), (3, 3, "ALN", "ABCDE", None), (3, 4, "NUM", digits, None)]
    whole = pages._digits([words[50], 0, 0x1FFFFF], [True] * 3, 2)
    assert len(digits) < len(whole) == 15 and whole.startswith(digits[:4]) and digits.endswith("[" * 4)


def test_frames_are_made_by_the_hash_of_spark(spark):
    keys = [0, 1, 599_999, -5, 1 << 40]
    df = spark.createDataFrame([(k, i) for k in keys for i in (0, 1, 87)], "k long, i int")
    for r in df.select("k", "i", F.xxhash64("k", "i").alias("h")).collect():
        assert walks.xxhash64(np.array([r.k]), np.array([r.i]))[0] == r.h


def test_pages_of_many_frames(spark, tmp_path):
    """30,000 frames; with words made again for every mention 1,500 took some 20 s."""
    spark.range(30_000).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    began = time.time()
    assert walks.frame_pages(spark, str(tmp_path)).selectExpr("count(DISTINCT frame_id)").first()[0] > 29_000
    assert time.time() - began < 60


@pytest.mark.parametrize("samples", [0, 5, 1000])
def test_iq_file(spark, tmp_path, samples):
    path, iq = tmp_path / "capture", np.arange(2 * samples, dtype="<f4")
    path.write_bytes(iq.tobytes() + b"abc")
    rows = sorted(read_iq(spark, str(path), chunk=64, split=2048).collect())
    assert b"".join(r.iq for r in rows) == iq.tobytes()
    assert [r.start for r in rows] == list(range(0, samples, 64))


def drain(spark, stream, tmp_path, name):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "o"))


def test_iq_stream(spark, tmp_path):
    path, iq = tmp_path / "capture", np.arange(600, dtype="<f4")
    for upto in (200, 600):
        path.write_bytes(iq[:upto].tobytes())
        out = drain(spark, stream_iq(spark, str(path), chunk=64), tmp_path, "iq")
    assert b"".join(r.iq for r in sorted(out.collect(), key=lambda r: r.start)) == iq.tobytes()


def test_log_tail(spark, tmp_path):
    a = tmp_path / "a.log"
    for text in ("one\ntwo\nhal", "one\ntwo\nhalf\nthree\n"):
        a.write_text(text)
        out = drain(spark, tail_logs(spark, str(tmp_path / "*.log")), tmp_path, "log")
    assert sorted(r.value for r in out.collect()) == ["half", "one", "three", "two"]


def test_long_runs_of_digits_and_bits(spark):
    """2,000 words a row: with the bits of all words made again for each digit this never ended."""
    rng = random.Random(3)
    rows = [(i, [rng.randrange(1 << 21) for _ in range(n)], [rng.randrange(2) for _ in range(7 * n + 3)]) for i, n in enumerate((0, 1, 2, 88, 2000))]
    df = spark.createDataFrame(rows, "i int, w array<bigint>, b array<int>")
    got = df.select(fec.digits(F.col("w"), 6).alias("d"), fec.seven_bit(F.col("b")).alias("s"), "i").orderBy("i").collect()
    for (_, words, b), r in zip(rows, got):
        bits = [w >> k & 1 for w in words for k in range(21)][6:]
        codes = [sum(bits[g + k] << k for k in range(4)) for g in range(0, len(bits) - 3, 4)]
        assert r.d == "".join("0123456789 U -]["[c] for c in codes if c != 12)
        assert r.s == [c for c in (sum(b[g + k] << k for k in range(7)) for g in range(0, len(b) - 6, 7)) if c not in (0, 4)]
