import hashlib

from tessera.llm import warc

SCHEMA = "page_id long, url string, html string, shard int, payload string"


def pages():
    big, small = "<p>é " + "a" * 200, "tiny"
    rows = [(i, f"http://x/{i}\r\nEvil: 1", big if i % 3 == 0 else f"{i} " + "b" * (i * 7), 0, "") for i in range(60)]
    rows += [(100, None, None, 0, ""), (101, "u", small, 0, ""), (102, "u", small, 0, ""), (103, "u", "", 0, ""), (104, "u", "z\n" * 300_000, 0, "")]
    rows += [(None, "n", "null key " * 40, 0, ""), (5, "again", "b" * 500, 0, ""), (200, "again", "b" * 500, 0, "")]
    return rows


def expected(rows):
    first = {}
    for k, _, h, *_ in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and k is not None:
            first[raw] = min(first.get(raw, k), k)
    out = []
    for k, _, h, *_ in rows:
        raw = (h or "").encode()
        ref = first.get(raw)
        revisit = ref is not None and k is not None and k > ref
        out.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", ref if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages()
    out = warc.round_trip(spark.createDataFrame(rows, SCHEMA))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()]
    assert sorted(got, key=str) == expected(rows)


def test_same_files_whatever_the_partitions(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA)
    made = []
    for k, n in enumerate((1, 5)):
        m = warc.write_warc(df.repartition(n), f"file://{tmp_path}/{k}", file_bytes=2000, shard_bytes=30_000)
        made.append(sorted((r.file, r.sha256, r.records) for r in m.collect()))
        assert {p.name for p in (tmp_path / str(k)).glob("*.warc.gz")} == {x[0] for x in made[-1]}
    assert made[0] == made[1] and len(made[0]) > 3


def test_empty_and_damaged(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.round_trip(empty).count() == 0
    m = warc.write_warc(spark.createDataFrame(pages(), SCHEMA), f"file://{tmp_path}/d")
    part = next((tmp_path / "d").glob("*.warc.gz"))
    part.write_bytes(part.read_bytes()[:-40])
    try:
        warc.read_warc(f"file://{tmp_path}/d", m).count()
        raise AssertionError("damage not seen")
    except Exception as e:
        assert "cut short" in str(e) or "differs" in str(e) or "Damaged" in str(e) or "zlib" in str(e)
