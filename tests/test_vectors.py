"""Small known cases of the operators."""

import hashlib
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from logloom.functions import codec
from logloom.operators import catalog as cat
from logloom.operators import conformance, measurement, quorum, writepath
from logloom.sources import traces


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_crc32c_check_value(spark):
    assert f"{one(spark, codec.crc32c(F.lit(b'123456789'))):08x}" == "e3069283"


def test_watermark(spark):
    for values, n, want in (([7], 1, 7), ([1, 9, 5], 3, 5), ([1, 9, 5, 7, 3], 5, 5)):
        df = spark.createDataFrame([(0, z, v) for z, v in enumerate(values)], "seg long, zone int, durable long")
        assert quorum.watermark(df, n // 2 + 1).first().watermark == want


def test_recovery_size(spark):
    for sizes, n, want in (([10, 20, 20], 3, 20), ([10, 20], 3, 20), ([10, 20, 30, 40], 5, 30), ([10, 20, 30, 40, 50], 5, 30), ([10], 3, None)):
        df = spark.createDataFrame([(0, z, v) for z, v in enumerate(sizes)], "seg long, zone int, size long")
        assert quorum.recovery_size(df, n).first()["size"] == want


def tables(spark, cases):
    """frames, copies, sizes of cases, each {zone: frames}; a frame of one character has one byte."""
    rows = [(k, z, i, f, i + 1) for k, copies in enumerate(cases) for z, fs in copies.items() for i, f in enumerate(fs)]
    f = spark.createDataFrame(rows, "seg long, zone int, ordinal long, frame string, record_end long")
    c = spark.createDataFrame([(k, z) for k, copies in enumerate(cases) for z in copies], "seg long, zone int")
    s = spark.createDataFrame([(k, z, len(fs)) for k, copies in enumerate(cases) for z, fs in copies.items()], "seg long, zone int, size long")
    return f, c, s


def brute_canonical(copies, n):
    """(len, zones, conflict_at, bytes, discarded) of one case; None below a quorum."""
    q, zones = n // 2 + 1, sorted(copies)
    if len(zones) < q:
        return None
    cut = sorted(map(len, copies.values()), reverse=True)[q - (n - len(zones)) - 1]
    held = {z: copies[z][:cut] for z in zones}
    differ = lambda a, b: next((i for i, (x, y) in enumerate(zip(held[a], held[b], strict=False)) if x != y), None)
    first = next((d for a, b in combinations(zones, 2) if (d := differ(a, b)) is not None), 0)
    offers = []
    for group in combinations(zones, q):
        if all(differ(a, b) is None for a, b in combinations(group, 2)):
            offers.append((group, held[max(group, key=lambda z: (len(held[z]), -z))]))
    if not offers:
        return None, None, first, None, None
    top = max(len(x) for _, x in offers)
    best = [o for o in offers if len(o[1]) == top]
    for _, x in best[1:]:
        if x != best[0][1]:
            return None, None, next(i for i in range(top) if x[i] != best[0][1][i]), None, None
    return top, ",".join(map(str, best[0][0])), None, top, max(map(len, copies.values())) > top


@pytest.mark.parametrize("n", [1, 3, 5])
def test_canonical_prefix_is_brute_force(spark, n):
    rng = random.Random(n)
    cases = [{0: "ab", 1: "a"}, {0: "a", 1: "b"}, {0: "x", 1: "g", 2: "g"}, {0: "", 1: "l", 2: "r"}] if n == 3 else []
    for _ in range(300):
        zones = rng.sample(range(n), rng.randint(1, n))
        base = "".join(rng.choice("ab") for _ in range(6))
        cases.append({z: (base if rng.random() < 0.7 else "".join(rng.choice("ab") for _ in range(6)))[: rng.randint(0, 6)] for z in zones})
    want = {k: w for k, c in enumerate(cases) if (w := brute_canonical(c, n)) is not None}
    got = {r.seg: tuple(r)[1:] for r in quorum.canonical_prefix(*tables(spark, cases), n).collect()}
    assert got == want


def test_expected_prefix(spark):
    p = spark.createDataFrame([(0, 5, None), (1, 5, None), (2, None, 3), (3, 5, None)], "seg long, len long, conflict_at long")
    e = spark.createDataFrame([(0, 3), (1, 6), (2, 1), (3, None)], "seg long, expected long")
    got = {r.seg: (r["len"], r.error) for r in quorum.expected_prefix(p, e).collect()}
    assert got == {0: (3, None), 1: (None, "RecoveryPrefixTooShort"), 2: (None, "ConflictingPrefix"), 3: (5, None)}


def test_digest_tells_where_records_end(spark):
    f = spark.createDataFrame([(0, 0, 0, "a\nb"), (0, 1, 0, "a"), (0, 1, 1, "b")], "seg long, zone int, ordinal long, frame string")
    assert len({r.digest for r in quorum.copy_digests(f).collect()}) == 2


def test_admission(spark):
    rows = [(1, 0, 0, 4, False, True), (1, 1, 2, 4, False, True), (1, 2, 1, 99, False, True), (1, 3, 1, 4, False, False), (1, 4, 1, 12, False, True), (1, 5, 1, 4, False, True), (1, 6, 2, 4, True, True), (2, 0, None, 4, False, True)]
    df = spark.createDataFrame(rows, "engine long, attempt long, seqno long, payload_bytes long, closed boolean, seal_room boolean")
    got = [r.outcome for r in writepath.admission(df, 20, 20).orderBy("engine", "attempt").collect()]
    assert got == ["Admitted", "OutOfOrder", "RecordTooLarge", "SegmentDirectoryFull", "ActiveSegmentFull", "Admitted", "Closed", "OutOfOrder"]


def test_completion(spark):
    records = spark.createDataFrame([(i, i // 3, i % 3) for i in range(9)], "record_index long, seg long, ordinal long")
    resolved = spark.createDataFrame([(0, 3), (1, 1), (2, 3)], "seg long, committed long")
    for status, want in (("Pending", ["Pending"] * 5), ("Fenced", ["Fenced", *["Poisoned"] * 4])):
        s = spark.createDataFrame([(0, "Committed"), (1, status), (2, "Committed")], "seg long, status string")
        got = [r.outcome for r in writepath.completion(records, resolved, s, "0").orderBy("record_index").collect()]
        assert got == ["Done"] * 4 + want


def test_register_rules(spark):
    cols = "version long, epoch long, tail_base long, tail_id string, pending_id string, seal_id string, seal_base long, seal_digest string, trunc long, ids array<string>, bases array<bigint>, buckets array<string>"
    ok = (1, 30, "t", "p", "b", 20, "d", 0, ["a", "b"], [10, 20], ["x"])
    cases = [(ok, None), ((*ok[:8], [], [], ["x"]), None), ((*ok[:8], None, None, ["x"]), None), ((1, 15, *ok[2:9], [20, 10], ["x"]), "base_below_tail"), ((*ok[:4], "a", *ok[5:]), "last_is_seal"), ((*ok[:8], ["a", "a"], [10, 10], ["x"]), "bases_increase")]
    got = cat.validate_registers(spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], cols)).orderBy("version").collect()
    assert [r.first_failed_rule for r in got] == [w for _, w in cases]


def test_chain_over_ranges(spark):
    bases = [0, 5, 100, 101, 950, 7000, 7001]
    got = cat.chain(spark.createDataFrame([(b,) for b in bases], "base long"), 8000, width=100).orderBy("base").collect()
    assert [r.end for r in got] == [4, 99, 100, 949, 6999, 7000, 7999]


def test_names_and_digests_from_files(spark, tmp_path):
    (tmp_path / "names.txt").write_text("\n".join(traces.EVENTS) + "\n")
    assert traces.name_parity(traces.read_names(spark, str(tmp_path / "names.txt")), traces.EVENTS).where("NOT same").count() == 0
    line = '{"seq": 0, "event": "SealedCopyRepaired", "segment": 3, "record_end": 9}\n'
    (tmp_path / "t.jsonl").write_text(line)
    assert [r.digest for r in traces.digests(spark, str(tmp_path)).collect()] == [hashlib.sha256(line.encode()).hexdigest()]
    assert traces.with_derived(traces.read(spark, str(tmp_path))).first().record_count == 7
    traces.write(traces.read(spark, str(tmp_path)).withColumn("trace_id", F.lit("t")), str(tmp_path / "out"))
    assert traces.read(spark, str(tmp_path / "out" / "trace_id=t"), "*.json").first().record_end == 9


def test_frames_round_trip(spark):
    spark.udtf.register("decode_frames", codec.decode_frames())
    df = spark.createDataFrame([("alpha",), ("",), ("beta",)], "p string").coalesce(1)
    joined = b"".join(bytes(r[0]) for r in df.select(codec.frame(F.col("p"))).collect())
    got = spark.createDataFrame([(joined + b"\x00\x00\x00\x09be",)], "c binary")
    got.createOrReplaceTempView("frames_in")
    rows = spark.sql("SELECT f.* FROM frames_in, LATERAL decode_frames(c, false) f").collect()
    assert [bytes(r.payload) for r in rows] == [b"alpha", b"", b"beta"] and rows[-1].end == len(joined)


def test_packing_boundary(spark):
    df = spark.createDataFrame([(0, 0, 262_143), (0, 1, 2)], "seg long, record_index long, encoded_len long")
    assert [r.bytes for r in writepath.pack_messages(df, 1 << 18).orderBy("message").collect()] == [262_143, 2]


def test_hdr_is_exact_when_small(spark):
    df = spark.createDataFrame([(1,), (2047,), (2048,), (4097,)], "us long").select(measurement.hdr_highest(F.col("us")).alias("h"))
    assert [r.h for r in df.collect()] == [1, 2047, 2049, 4099]


def test_rejecting_trace(spark):
    df = spark.createDataFrame([("t", 0, "GetSizeObserved", 0, 1, False)], "trace_id string, seq long, event string, zone long, reported_size long, finalized boolean")
    assert [r.assertion for r in conformance.size_excludes_open_tail(df).collect()] == ["A25"]


def test_trace_reader_keeps_unsigned_values(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"seq": 1, "event": "RecordFormed", "value": 18446744073709551615}\n\n{"seq": 2, "event": "ZoneCrash"}\n')
    rows = traces.read(spark, str(tmp_path)).orderBy("seq").collect()
    assert int(rows[0].value) == 2**64 - 1 and len(rows) == 2
