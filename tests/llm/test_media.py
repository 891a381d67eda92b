"""Transport streams, archives and the source mix."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelattice.llm import mixing, queries, shared, transport, warc

from .edge import documents, plain


@pytest.mark.parametrize("frames", [1, 2, 7, 8, 9, 64, 511, 512, 513, 600])
def test_streams_round_trip(frames):
    payload = np.random.default_rng(frames).integers(0, 256, 576 * frames, dtype=np.uint8)
    made = transport.demux(transport.mux(payload))
    assert made["errors"] == 0 and len(made["streams"]) == 1
    found = made["streams"][0]
    assert (found["payload"] == payload).all()
    assert found["pts"].tolist() == [90_000 + 17_280 * i for i in range(-(-frames // 8))]
    assert found["access_pts"].tolist() == found["pts"].tolist()


def test_lost_and_damaged_packets_are_found():
    stream = transport.mux(np.arange(576 * 16, dtype=np.uint64).astype(np.uint8))
    with pytest.raises(ValueError):
        transport.demux(stream[: 188 * 6] + stream[188 * 7 :])
    with pytest.raises(ValueError):
        transport.demux(b"\0" + stream[1:])
    with pytest.raises(ValueError):
        transport.demux(stream[:10] + bytes([stream[10] ^ 1]) + stream[11:])
    swapped = bytearray(stream)
    swapped[188 * 4 + 3] ^= 1
    assert transport.demux(bytes(swapped))["errors"] > 0


def packet(pid, counter, data, *, opens=False, flags=None, extra=b""):
    """A transport packet; ``flags`` and ``extra``: an adaptation field, stuffed so that the packet is full."""
    head = bytes([0x47, (0x40 if opens else 0) | pid >> 8, pid & 0xFF])
    if flags is None and len(data) == 184:
        return head + bytes([0x10 | counter]) + data
    field = bytes([flags or 0]) + extra
    field += b"\xff" * (183 - len(data) - len(field))
    return head + bytes([(0x30 if data else 0x20) | counter, len(field)]) + field + data


def table(pid, counter, section):
    return packet(pid, counter, b"\0" + section + b"\xff" * (183 - len(section)), opens=True)


def elementary(ident, data, pts=None, dts=None, stated=True):
    stamps = b"".join(transport._stamp(np.array([t])).tobytes() for t in (pts, dts) if t is not None)
    body = bytes([0x80, (0x80 if pts is not None else 0) | (0x40 if dts is not None else 0), len(stamps) + 2]) + stamps + b"\xff\xff" + data
    return b"\0\0\x01" + bytes([ident]) + (len(body) if stated else 0).to_bytes(2, "big") + body


def test_foreign_streams_with_descriptors_duplicates_and_open_lengths():
    entry = lambda kind, pid, info=b"": bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info
    association = transport._section(0, 1, (0).to_bytes(2, "big") + (0xE010).to_bytes(2, "big") + (7).to_bytes(2, "big") + (0xE040).to_bytes(2, "big"))
    program = transport._section(2, 7, (0xE051).to_bytes(2, "big") + b"\xf0\x04" + b"\x05\x02ab" + entry(0x1B, 0x51, b"\x28\x01x") + entry(0x0F, 0x52, b"\x0a\x04eng\0"))
    video, audio = bytes(range(256)) * 3, b"sound" * 20
    first, second = elementary(0xE0, video, 9000, 6000, stated=False), elementary(0xE0, b"last", stated=False)
    sound = elementary(0xC0, audio, 4500)
    cuts = [first[at : at + 184] for at in range(0, len(first), 184)]
    rows = [table(0, 3, association), table(0x40, 9, program)]
    rows += [packet(0x51, k, c, opens=k == 0) for k, c in enumerate(cuts)]
    n = len(cuts)
    rows.insert(3, rows[2])  # a packet sent twice
    rows.insert(5, packet(0x51, 1, b"", flags=0x10))  # no payload: the counter stays
    rows += [packet(0x52, 15, sound, opens=True, flags=0x40), table(0, 4, association)]
    rows += [packet(0x51, n % 16, second, opens=True, flags=0x40)]
    assert all(len(r) == 188 for r in rows)
    found = transport.demux(b"".join(rows))
    assert found["errors"] == 0 and found["packets"] == len(rows)
    a, b = found["streams"]
    assert (a["program"], a["pid"], a["kind"]) == (7, 0x51, 0x1B) and (b["program"], b["pid"], b["kind"]) == (7, 0x52, 0x0F)
    assert a["payload"].tobytes() == video + b"last" and b["payload"].tobytes() == audio
    assert a["pts"].tolist() == [9000, -1] and a["dts"].tolist() == [6000, -1] and b["pts"].tolist() == [4500]
    assert a["access_offset"].tolist() == [188 * (len(rows) - 1)] and a["access_pts"].tolist() == [-1] and b["access_pts"].tolist() == [4500]
    lost = rows[:6] + rows[7:]
    assert transport.demux(b"".join(lost))["errors"] == 1
    thrice = rows[:3] + [rows[2]] + rows[3:]
    assert transport.demux(b"".join(thrice))["errors"] == 1


def brute_stream(payload):
    """The stream by the letter, a packet at a time."""
    out = []
    full, sent = 576 * 8, 0
    parts = [payload[at : at + full] for at in range(0, len(payload), full)]
    for k, part in enumerate(parts):
        if k % 64 == 0:
            c = k // 64 & 15
            association = transport._section(0, 1, bytes([0, 1, 0xE1, 0]))
            program = transport._section(2, 1, bytes([0xE1, 1, 0xF0, 0, 6, 0xE1, 1, 0xF0, 0]))
            for pid, section in ((0, association), (256, program)):
                out.append(bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | c, 0]) + section + b"\xff" * (183 - len(section)))
        pts = 90_000 + 17_280 * k
        stamp = lambda t: bytes([0x21 | t >> 29 & 14, t >> 22 & 255, 1 | t >> 14 & 254, t >> 7 & 255, 1 | t << 1 & 254])
        whole = b"\0\0\x01\xbd" + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(pts) + part
        clock = pts - 9_000
        first = bytes([7, 0x50]) + (clock << 15 | 0x7E00).to_bytes(6, "big")
        out.append(bytes([0x47, 0x41, 1, 0x30 | sent & 15]) + first + whole[:176])
        sent += 1
        for at in range(176, len(whole), 184):
            own = whole[at : at + 184]
            gap = 184 - len(own)
            field = b"" if not gap else bytes([gap - 1]) + (b"\0" + b"\xff" * (gap - 2) if gap > 1 else b"")
            out.append(bytes([0x47, 1, 1, (0x30 if gap else 0x10) | sent & 15]) + field + own)
            sent += 1
    return b"".join(out)


def check_media(rows, texts):
    for r in rows:
        data = texts[r["doc_id"]].encode()
        n = max(1, -(-len(data) // 576)) * 576
        payload = data + b"\xff" * (n - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stream = brute_stream(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
        packets = [stream[at : at + 188] for at in range(0, len(stream), 188)]
        access = [188 * i for i, p in enumerate(packets) if p[1] & 0x40 and p[2] == 1 and p[3] & 0x20 and p[5] & 0x40]
        stamps = [90_000 + 17_280 * k for k in range(len(access))]
        assert r["feature"] == f"packets={len(packets)};errors=0;pts={stamps[0]}-{stamps[-1]};access=" + ",".join(f"{t}@{o}" for t, o in zip(stamps, access, strict=True))


def test_media_query(spark, data):
    rows = queries.op7_transport_streams(spark, data).collect()
    texts = dict(plain(spark.read.parquet(f"{data}/documents.parquet")))
    assert len(rows) == len(texts)
    check_media(rows, texts)


def test_media_batches_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(transport, "BATCH_BYTES", 5_000)
    values = [b"x" * n for n in (0, 1, 20_000, 576, 577, 100_000)]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, data binary").coalesce(1)
    rows = transport.load(transport.store(df)).collect()
    assert {r["doc_id"]: bytes(r["payload"]).rstrip(b"\xff") for r in rows} == dict(enumerate(values))


def test_media_of_odd_rows(spark):
    docs = documents(spark).withColumn("data", F.encode("text", "UTF-8")).withColumn("media", F.lit("clash"))
    rows = transport.load(transport.store(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        data = (r["text"] or "").encode()
        assert r["media_bytes"] == len(data) and bytes(r["payload"])[: len(data)] == data and set(bytes(r["payload"])[len(data) :]) <= {255}
    assert transport.load(transport.store(docs.limit(0))).count() == 0


# ---------------------------------------------------------------- archives


def brute_archive(rows):
    """Rows (page, html): bytes, digest, kind and original."""
    groups = {}
    for page, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        ids = [p for p in groups[data] if p is not None]
        first = max(ids) if ids else None
        again = len(data) >= 1000 and page != first
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def archived(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


def test_archive_of_odd_pages(spark):
    big, other = "<p>é</p>" * 200, "<b>x</b>" * 200
    rows = [(1, "http://a/ b", big), (2, None, big), (9, "http://c", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", other), (7, "u", other), (None, "u", big), (8, "u", other + "\r\n\r\n"), (None, None, None)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    assert archived(warc.archive(pages)) == brute_archive([(p, h) for p, _, h in rows])
    assert warc.archive(pages.limit(0)).count() == 0


def test_archives_open_with_their_record_and_revisits_name_what_they_refer_to(spark, tmp_path):
    big = "<p>x</p>" * 200
    pages = spark.createDataFrame([(1, "http://a/1", big), (2, "http://a/2 x", big), (3, "http://a/3", "small")], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(warc.decide(pages), f"file://{tmp_path}/w")
    records = [warc.parse(r) for r in warc.read_members(index[0]["path"])]
    kinds = {h["WARC-Type"] for h, *_ in records}
    assert [h["WARC-Type"] for h, *_ in records][0] == "warcinfo" and kinds == {"warcinfo", "response", "revisit"} and len(records) == 4
    revisit = next(h for h, *_ in records if h["WARC-Type"] == "revisit")
    response = next(h for h, *_ in records if h.get("X-Page-ID") == "2")
    assert revisit["WARC-Refers-To"] == response["WARC-Record-ID"] and revisit["WARC-Refers-To-Target-URI"] == response["WARC-Target-URI"] == "http://a/2%20x"
    assert revisit["WARC-Refers-To-Date"] == response["WARC-Date"] and response["WARC-Date"] > "2020"


def test_hot_payload_and_record_ids(spark):
    rows = [(i, "u", "<i>z</i>" * 200 if i % 3 else f"<i>{i}</i>" * 200) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = warc.archive(pages)
    assert archived(found) == brute_archive([(p, h) for p, _, h in rows])
    assert found.select("record_id").distinct().count() == 600


def test_archive_query_matches_sql(spark, data, duck):
    want = duck.sql(queries.SQL["op9_warc_revisits"])
    found = queries.op9_warc_revisits(spark, data).select(*want.columns).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want.fetchall(), key=str)


# ---------------------------------------------------------------- mix


def test_mix_query_matches_sql(spark, data, duck):
    want = duck.sql(queries.SQL["op8_source_mix"])
    found = queries.op8_source_mix(spark, data).select(*want.columns).collect()
    assert sorted(map(tuple, found)) == sorted(want.fetchall())


def waterfill(words, weights=(1, 2, 3), most=3):
    """Targets by sharing again and again, as the rule is worded."""
    total, capped = sum(words), {}
    w = [weights[i % len(weights)] for i in range(len(words))]
    while True:
        open_ = [i for i in range(len(words)) if i not in capped]
        left = total - sum(capped.values())
        share = {i: left * w[i] / sum(w[k] for k in open_) for i in open_}
        above = {i: most * words[i] for i in open_ if share[i] > most * words[i] * (1 + 1e-12)}
        if not above:
            return [capped.get(i, share.get(i)) for i in range(len(words))]
        capped |= above


@pytest.mark.parametrize("words", [[10, 10, 10], [1, 1000, 3, 5, 900], [0, 5, 0, 7], [100, 1, 1, 1, 1, 1, 50], [4]])
def test_targets(spark, words):
    df = spark.createDataFrame([(f"s{i:02d}", w) for i, w in enumerate(words)], "key string, words long")
    found = [r["target"] for r in mixing.targets(df).orderBy("key").collect()]
    assert found == pytest.approx(waterfill(words))


def test_mix_of_odd_rows(spark):
    mixed = mixing.mix(documents(spark)).collect()
    assert len(mixed) == documents(spark).count()
    sizes = {}
    for r in mixed:
        assert r["size"] == len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r["text"] or "") if w])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert 0 <= r["copies"] <= 3
    order = sorted(s for s in sizes if s is not None) + [None]
    want = dict(zip(order, waterfill([sizes[s] for s in order]), strict=True))
    assert all(r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] for r in mixed)
    assert mixing.repeated(mixing.mix(documents(spark))).count() == sum(r["copies"] for r in mixed)
    assert mixing.mix(documents(spark, empty=True)).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_null_and_repeated_keys_draw_apart(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(shared, "MOST_BROADCAST", 0)
    rows = [(None, "one two three four", "a")] * 400 + [(7, f"word{i} and more", "b") for i in range(400)] + [(i, "five words of text here", "c") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    mixed = mixing.mix(df).collect()
    assert len(mixed) == len(rows)
    for source in "abc":
        own = [r for r in mixed if r["source"] == source]
        taken = sum(r["size"] * r["copies"] for r in own)
        assert taken == pytest.approx(own[0]["target"], rel=0.2)
    key = lambda r: (str(r["doc_id"]), r["text"], r["copies"])
    assert sorted(map(key, mixed)) == sorted(map(key, mixing.mix(df.repartition(3)).collect()))


def test_mix_of_repeated_rows_matches_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    df = documents(spark).select("doc_id", "text", "source")
    documents_ = df.unionByName(df).toPandas().astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents_)
    want = con.sql(queries.SQL["op8_source_mix"])
    mixed = mixing.mix(df.unionByName(df)).withColumn("taken", F.col("size") * F.col("copies"))
    assert sorted(map(str, map(tuple, mixed.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
