import gzip
import hashlib
import os
from collections import defaultdict

import pytest

from adyield.llm import warc
from adyield.session import ensure_checkpoint_dir


def folder(spark, name):
    import uuid
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


ROWS = [(1, "http://a/1", "x" * 2000), (2, "http://a/2", "x" * 2000), (7, "http://a/é\r\nX: y", "x" * 2000), (3, None, "x" * 999),
        (4, "http://a/4", "x" * 999), (5, "http://a/5", None), (6, "http://a/6", ""), (8, "u", "é" * 500), (9, "v", "é" * 500),
        (None, "w", "x" * 2000), (10, "z", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 400)]


def brute(rows):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    out = {}
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in groups[data] if x is not None]
        revisit = len(data) >= 1000 and ids and i != max(ids)
        out[i] = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None)
    return out


def table(df):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


def test_round_trip(spark):
    at = folder(spark, "warc")
    manifest = warc.write(pages(spark, ROWS), at, shard_bytes=4000, roll_bytes=500)
    assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS)
    back = warc.read(spark, at)
    assert table(back) == brute(ROWS)
    html = {i: h or "" for i, _, h in ROWS}
    for r in back.filter("record_type = 'response'").collect():
        assert bytes(r["payload"]).decode() == html[r["page_id"]]


def test_whole_table(spark, small):
    at = folder(spark, "warc")
    warc.write(small("pages"), at)
    rows = [(r["page_id"], r["url"], r["html"]) for r in small("pages").collect()]
    assert table(warc.read(spark, at, with_payload=False)) == brute(rows)


def test_same_files_whatever_the_partitioning(spark):
    df = pages(spark, ROWS)
    key = lambda m: sorted(tuple(r) for r in m.collect())
    one = key(warc.write(df.repartition(7), folder(spark, "warc"), 4000, 500))
    assert one == key(warc.write(df.coalesce(1), folder(spark, "warc"), 4000, 500)) and len(one) > 3


def test_files_are_plain_gzip_members_and_temporary_names_are_gone(spark):
    at = folder(spark, "warc")
    names = [r["file"] for r in warc.write(pages(spark, ROWS), at, 1 << 20).collect()]
    local = at.removeprefix("file://").removeprefix("file:")
    assert sorted(n for n in os.listdir(local) if n != "manifest") == sorted(names)
    with gzip.open(os.path.join(local, names[0])) as f:
        assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_files_outside_the_manifest_are_not_read(spark):
    at = folder(spark, "warc")
    warc.write(pages(spark, ROWS), at)
    local = at.removeprefix("file://").removeprefix("file:")
    with open(os.path.join(local, "shard-000099-00000.warc.gz"), "wb") as f:
        f.write(b"left by a lost task")
    assert warc.read(spark, at).count() == len(ROWS)


def test_damage_is_noticed():
    raw = gzip.decompress(warc.build_record(1, "http://a/", b"payload", None, 0))
    assert warc.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload", b"pAyload"))


def test_repeated_rows_nulls_and_empty_table(spark):
    rows = [(1, "a", "y" * 1500), (1, "a", "y" * 1500), (None, "b", "z" * 1500), (None, "b", "z" * 1500)]
    at = folder(spark, "warc")
    warc.write(pages(spark, rows), at)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.read(spark, at).collect())
    assert got == [(0, "response", None), (0, "response", None), (1, "response", None), (1, "revisit", 1)]
    at = folder(spark, "warc")
    assert warc.write(pages(spark, []), at).count() == 0 and warc.read(spark, at).count() == 0


def test_text_ids_come_back(spark):
    ids = ["a:b", "a:c", "-", "", "é/ %3A", "a\r\nb", "<x>", "~", None]
    df = spark.createDataFrame([(i, "u", "y" * 1500) for i in ids] + [("own", "u", str(i)) for i in range(1)],
                               "page_id string, url string, html string").selectExpr("*", "1 as shard", "2 as digest", "3 as original", "4 as key")
    at = folder(spark, "warc")
    warc.write(df, at)
    back = warc.read(spark, at, id_type="string").collect()
    assert sorted(r["page_id"] or "" for r in back) == sorted(i or "" for i in [*ids, "own"])
    assert sum(r["page_id"] is None for r in back) == 1
    top = max(i for i in ids if i is not None)
    assert {r["refers_to"] for r in back if r["record_type"] == "revisit"} == {top}


def test_shards_are_ranges_and_files_roll(spark):
    import random
    rng = random.Random(1)
    ids = [*range(400), *range(5000, 5003), 10 ** 15, None]
    rows = [(i, "u", "".join(rng.choice("abcdefgh") for _ in range(900))) for i in ids] + [(7, "v", str(k) * 700) for k in range(60)]
    at = folder(spark, "warc")
    files = sorted(r["file"] for r in warc.write(pages(spark, rows), at, shard_bytes=20_000, roll_bytes=4_000).collect())
    shards = {f.split("-")[1] for f in files}
    assert len(shards) > 10 and len(files) > 2 * len(shards)             # several files a shard
    root, base = warc.open_folder(at)
    found = []
    for f in files:
        with root.open_input_stream(f"{base}/{f}", compression=None) as stream:
            found.append([warc.parse_record(raw)["page_id"] for raw in warc.records(stream)])
        assert sum(len(x) for x in found[-1:]) <= 20
    flat = [i for x in found for i in x]
    assert sorted(flat, key=str) == sorted((str(r[0]) if r[0] is not None else None for r in rows), key=str)
    assert flat[-2:] == [str(10 ** 15), None]
    by_shard = {}
    for f, x in zip(files, found):
        by_shard.setdefault(f.split("-")[1], []).extend(x)
    # ids up to 5002 share an interval of the range up to 10^15 and are dealt by hash, in order within a shard
    assert all([int(i) for i in x if i] == sorted(int(i) for i in x if i) for x in by_shard.values())
    even = [(i, "u", "z" * 800 + str(i)) for i in range(600)]
    at = folder(spark, "warc")
    files = sorted(r["file"] for r in warc.write(pages(spark, even), at, shard_bytes=30_000, roll_bytes=4_000).collect())
    flat = []
    for f in files:
        with root.open_input_stream(f"{base.rsplit('/', 1)[0]}/{at.rsplit('/', 1)[1]}/{f}", compression=None) as stream:
            flat += [int(warc.parse_record(raw)["page_id"]) for raw in warc.records(stream)]
    assert flat == list(range(600))
