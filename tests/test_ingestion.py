from __future__ import annotations

import csv
import ipaddress
import json
import random
import struct
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from ledgermill.functions.network import ip_key, ip_to_long, is_public, is_public_key
from ledgermill.operators import enrich, validate
from ledgermill.sources import fixtures, mmdb, readers, sinks

VALID = {"tx_id": "a" * 64, "timestamp": "2026-01-01T00:00:00", "src_wallet": "1" + "x" * 33, "dst_wallet": "1" + "y" * 33, "amount_btc": "0.5", "broadcast_ip": "41.12.0.1", "asn": "AS1000"}


def check(spark, *rows):
    schema = ", ".join(f"{f} string" for f in VALID)
    return validate.validate(spark.createDataFrame([tuple((VALID | r).get(f) for f in VALID) for r in rows], schema))


def reason(spark, **change):
    return check(spark, change)[1].first().reject_reason


def test_valid_record_is_coerced(spark):
    clean, rejected = check(spark, {})
    row = clean.first()
    assert rejected.count() == 0
    assert row.amount_btc == 0.5
    assert row.src_wallet == VALID["src_wallet"]
    assert str(row.timestamp) == "2026-01-01 00:00:00"


def test_missing_zero_self_and_bad_values(spark):
    assert reason(spark, amount_btc=None) == "missing required field: amount_btc"
    assert reason(spark, amount_btc="0") == "amount_btc must be positive"
    assert reason(spark, amount_btc="not_a_number") == "amount_btc is not numeric"
    assert reason(spark, amount_btc="1_000") == "amount_btc is not numeric"
    assert reason(spark, amount_btc="1.0d") == "amount_btc is not numeric"
    assert reason(spark, dst_wallet=" " + VALID["src_wallet"]).startswith("self transfer")
    assert reason(spark, tx_id=" ab ") == "tx_id is too short"
    assert reason(spark, timestamp="T10:00") == "unparseable timestamp"
    assert reason(spark, timestamp="1700000000") == "unparseable timestamp"
    assert reason(spark, tx_id="", asn=None) == "missing required field: tx_id"


def test_lenient_cases_pass(spark):
    clean, rejected = check(spark, {"broadcast_ip": "   "}, {"amount_btc": "inf"}, {"amount_btc": "NaN"}, {"timestamp": "2026-01-01T05:30:00+05:30"}, {"timestamp": "2026-01-01"}, {"timestamp": "2026-01-01 00:00:00.250Z"}, {"amount_btc": " 1e-3 "})
    assert rejected.count() == 0
    assert {str(r.timestamp) for r in clean.collect()} == {"2026-01-01 00:00:00", "2026-01-01 00:00:00.250000"}


def test_batch_split_keeps_every_record(spark):
    clean, rejected = check(spark, {}, {"amount_btc": "not_a_number"})
    assert (clean.count(), rejected.count()) == (1, 1)
    assert "reject_reason" in rejected.columns


def test_csv_json_xml_and_mixed(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(VALID) + "\n" + ",".join(VALID.values()) + "\n" + "short,row\n")
    (tmp_path / "b.JSON").write_text(json.dumps({"records": [VALID | {"timestamp": 1767225600, "amount_btc": 2, "memo": "x"}, VALID | {"timestamp": "1767225600"}]}))
    inner = "".join(f"<{k}> {v} </{k}>" for k, v in VALID.items() if k != "asn")
    (tmp_path / "c.xml").write_text(f"<all><batch><transaction asn='AS7'>{inner}<asn>AS1</asn></transaction><transaction><tx_id> </tx_id></transaction></batch></all>")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.JSON", "c.xml")]
    clean, rejected = validate.validate(readers.read_many(spark, paths))
    rows = clean.collect()
    assert len(rows) == 3
    assert {r.amount_btc for r in rows} == {0.5, 2.0}
    assert {str(r.timestamp) for r in rows} == {"2026-01-01 00:00:00"}
    assert "AS7" in {r.asn for r in rows}
    assert rejected.count() == 3
    (tmp_path / "list.json").write_text(json.dumps([VALID]))
    assert validate.validate(readers.read_any(spark, str(tmp_path / "list.json")))[0].count() == 1
    assert readers.read_many(spark, []).count() == 0


@pytest.mark.parametrize(("name", "body"), [("x.txt", ""), ("x.json", '{"other": []}'), ("x.json", "3"), ("x.json", '{"data": 5}')])
def test_bad_sources_raise(spark, tmp_path, name, body):
    (tmp_path / name).write_text(body)
    with pytest.raises(ValueError, match=r"reader|keys|list"):
        readers.read_any(spark, str(tmp_path / name))


def test_addresses_of_both_versions_like_the_library(spark):
    rng = random.Random(11)
    ips = ["8.8.8.8", "10.1.2.3", "127.0.0.1", "192.168.1.1", "172.31.0.1", "172.32.0.1", "240.0.0.1", "256.1.1.1", "text", None, "", "192.0.0.9", "2001:4860:4860::8888", "::1", "::", ":::", "1::2::3", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7:8", ":1:2:3:4:5:6:7:8", "2001:db8::G", "2001:DB8::ABCD", "2001:20::1", "2001:4:112::", "12345::", "::1.2.3", "1.2.3.4::"]
    for _ in range(300):
        words = [rng.choice([0, 1, 0x2001, 0x2A0C, 0xFE80, 0xFFFF, rng.getrandbits(16)]) for _ in range(8)]
        a = ipaddress.IPv6Address(sum(w << 16 * k for k, w in enumerate(words)))
        ips += [str(a), a.exploded.upper()]
    rows = spark.createDataFrame([(i,) for i in ips], "ip string").withColumn("k", ip_key(F.col("ip"))).withColumn("public", is_public_key(ip_key(F.col("ip")))).collect()
    for r in rows:
        try:
            a = ipaddress.ip_address(r.ip)
            a = getattr(a, "ipv4_mapped", None) or a
        except ValueError:
            assert r.k is None, r.ip
            assert not r.public
            continue
        assert (r.k.version, (r.k.hi % 2**64) << 64 | r.k.lo % 2**64) == (a.version, int(a)), r.ip
        assert r.public == (not (a.is_private or a.is_loopback or a.is_reserved)), r.ip


def test_longest_prefix_of_either_version(spark):
    blocks = spark.createDataFrame([("2a0c::/16", "A"), ("2a0c:1::/32", "B"), ("2a0c:1::5/128", "C"), ("2a0c:1:8000::/33", "D"), ("8.8.0.0/16", "E"), ("8.8.8.8/32", "F"), ("bad", "G"), ("2a0c:1::/32", "A2")], "network string, country string")
    blocks = blocks.selectExpr("network", "country", "null as city", "cast(null as double) as latitude", "cast(null as double) as longitude", "null as asn_org")
    want = {"2a0c:2::1": "A", "2a0c:1::1": "B", "2A0C:1:0:0:0:0:0:5": "C", "2a0c:1:9000::": "D", "8.8.1.1": "E", "8.8.8.8": "F", "::ffff:8.8.8.8": "F", "9.9.9.9": None, "2a0b::": None, "10.0.0.1": None, "x": None}
    rows = enrich.enrich(spark.createDataFrame([(i,) for i in want], "broadcast_ip string"), blocks).collect()
    assert {r.broadcast_ip: r.country for r in rows} == want


def test_longest_prefix_wins_and_absent_blocks_give_nulls(spark):
    rows = spark.createDataFrame([("41.12.1.9",), ("41.12.9.9",), ("9.9.9.9",), ("10.0.0.1",)], "broadcast_ip string")
    got = {r.broadcast_ip: r.country for r in enrich.enrich(rows, fixtures.geo(spark)).collect()}
    assert got == {"41.12.1.9": "KE", "41.12.9.9": "ZA", "9.9.9.9": None, "10.0.0.1": None}
    none = enrich.enrich(rows, None)
    assert set(enrich.GEO_FIELDS) <= set(none.columns)
    assert none.where("country is not null").count() == 0


def test_other_fields_survive_in_all_formats(spark, tmp_path):
    others = {"zip": "007", "note": 'a "b", <c>', "reject_reason": "mine", "extras": "1"}
    good, bad, plain = VALID | {"tx_id": "tx-good"} | others, VALID | {"tx_id": "tx-bad", "amount_btc": "x"} | others, VALID | {"tx_id": "tx-plain"}
    names = list(good)
    with open(tmp_path / "a.csv", "w", newline="") as f:
        out = csv.DictWriter(f, names)
        out.writeheader()
        out.writerows([good, bad, plain])
    nested = {"deep": {"list": [1, "2", None]}, "none": None}
    (tmp_path / "a.json").write_text(json.dumps([good | nested, bad, plain, 5]))
    child = lambda r: "".join(f"<{k}>{escape(str(v))}</{k}>" for k, v in r.items())
    (tmp_path / "a.xml").write_text(f'<all><transaction kind="k" zip="8">{child(good)}</transaction><transaction>{child(bad)}</transaction><transaction>{child(plain)}</transaction></all>')
    assert readers.read_many(spark, []).columns == readers.read_csv(spark, str(tmp_path / "a.csv")).columns
    for kind, more in (("csv", {}), ("json", nested), ("xml", {"kind": "k", "zip": "8"})):
        clean, rejected = validate.validate(readers.read_any(spark, str(tmp_path / f"a.{kind}")))
        got = {r.tx_id: r.extras and json.loads(r.extras.toJson()) for r in clean.collect()}
        assert got == {"tx-good": others | more, "tx-plain": None}, kind
        sinks.write_rejects(rejected, str(tmp_path / f"rejects-{kind}"))
        back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / f"rejects-{kind}")).where("tx_id = 'tx-bad'").first()
        assert json.loads(back.extras) == others
        assert back.reject_reason == "amount_btc is not numeric"
    clean = validate.validate(readers.read_many(spark, [str(tmp_path / f"a.{k}") for k in ("csv", "json", "xml")]))[0]
    clean.write.parquet(str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).where("variant_get(extras, '$.note', 'string') like '%<c>'").count() == 3


def test_json_lists_are_read_in_splits(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    odd = ["}", "{", "[", "]", '"', "\\", "\\}", '\\"}', "],[", "plain", "é漢", "\n", "{}", "[{"]
    records = [VALID | {"tx_id": f"t{k}", "asn": "".join(rng.choice(odd) for _ in range(rng.randint(0, 12))), "extra": {"a": [{"b": rng.choice(odd)}, []]}, "amount_btc": rng.choice([1.5, "2", None])} for k in range(120)]
    texts = {"indented": json.dumps(records, indent=2), "dense": json.dumps(records, separators=(",", ":"), ensure_ascii=False), "bom": "\ufeff \n" + json.dumps(records) + "\n\n", "one": json.dumps(records[:1]), "empty": "[]", "blank": " [ ] ", "scalars": json.dumps([1, records[0], "x}", records[1], None, [records[2]]])}
    for name, text in texts.items():
        path = tmp_path / f"{name}.json"
        path.write_text(text, encoding="utf-8")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            pieces = readers.json_pieces(spark, str(path))
            got = readers.read_json(spark, str(path))
            rows = sorted(map(repr, got.collect()))
            tasks = pieces.select("block").distinct().count()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert tasks >= len(text.encode()) // 1500
        with monkeypatch.context() as m:
            m.setattr(readers, "json_pieces", lambda *_: None)
            assert rows == sorted(map(repr, readers.read_json(spark, str(path)).collect())), name
    assert {json.loads(r._record)["asn"] for r in readers.read_json(spark, str(tmp_path / "dense.json")).collect()} == {r["asn"] for r in records}


def _encoded(value):
    """A value of the data section, without pointers."""
    head = lambda kind, n: (bytes([kind << 5 | min(n, 29)]) if kind < 8 else bytes([min(n, 29), kind - 7])) + (bytes([n - 29]) if n >= 29 else b"")
    if isinstance(value, str):
        return head(2, len(value.encode())) + value.encode()
    if isinstance(value, float):
        return head(3, 8) + struct.pack(">d", value)
    if isinstance(value, dict):
        return head(7, len(value)) + b"".join(_encoded(k) + _encoded(v) for k, v in value.items())
    if isinstance(value, list):
        return head(11, len(value)) + b"".join(map(_encoded, value))
    body = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return head(6, len(body)) + body


def _mmdb(networks, record_size, version, alias=None):
    """A file with these networks, built bit by bit; ``alias``: a network that points to the IPv4 tree as well."""
    root, data, places = [None, None], b"", {}
    length = 128 if version == 6 else 32
    longest = sorted(networks, key=lambda n: ipaddress.ip_network(n).prefixlen)

    def bits_of(n):
        net = ipaddress.ip_network(n)
        value, depth = int(net.network_address), net.prefixlen
        if version == 6 and net.version == 4:
            depth += 96
        return [value >> (length - 1 - k) & 1 for k in range(depth)]

    for n in longest:
        node, path = root, bits_of(n)
        for b in path[:-1]:
            if not isinstance(node[b], list):
                node[b] = [node[b], node[b]]
            node = node[b]
        node[path[-1]] = n
    if alias:
        node, four = root, root
        for b in bits_of(alias)[:-1]:
            node[b] = node[b] if isinstance(node[b], list) else [None, None]
            node = node[b]
        for _ in range(96):
            four = four[0]
        node[bits_of(alias)[-1]] = four
    order, todo = {}, [root]
    while todo:
        node = todo.pop()
        if id(node) not in order:
            order[id(node)] = (len(order), node)
            todo += [x for x in node if isinstance(x, list)]
    for n, record in networks.items():
        places[n] = len(data)
        data += _encoded(record)
    value = lambda x: len(order) if x is None else order[id(x)][0] if isinstance(x, list) else len(order) + 16 + places[x]
    out = b""
    for _, node in sorted(order.values(), key=lambda v: v[0]):
        a, b = map(value, node)
        if record_size == 28:
            out += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([a >> 24 << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            out += a.to_bytes(record_size // 8, "big") + b.to_bytes(record_size // 8, "big")
    meta = {"node_count": len(order), "record_size": record_size, "ip_version": version, "languages": ["en"]}
    return out + bytes(16) + data + mmdb.METADATA + _encoded(meta)


@pytest.mark.parametrize(("record_size", "version"), [(24, 4), (28, 6), (32, 6)])
def test_mmdb_like_its_networks(spark, tmp_path, record_size, version):
    record = lambda c, name, x: {"country": {"iso_code": c, "geoname_id": 70000}, "city": {"names": {"de": "x" * 40, "en": name}}, "location": {"latitude": x, "longitude": -x}}
    networks = {"8.8.0.0/16": record("US", "A", 1.5), "8.8.8.0/24": record("CA", "Bé", 2.5), "41.12.0.0/15": {"autonomous_system_organization": "South Net"}, "128.0.0.0/1": record("ZZ", "half", 9.0)}
    if version == 6:
        networks |= {"2a0c::/16": record("SE", "Six", 3.5), "2a0c:1::/32": record("NO", "Oslo", 4.5), "2a0c:1::5/128": record("IS", "Host", 5.5)}
    path = str(tmp_path / "geo.mmdb")
    (tmp_path / "geo.mmdb").write_bytes(_mmdb(networks, record_size, version, "2002::/16" if version == 6 else None))
    rows = [tuple(r) for r in readers.read_cidr(spark, path).collect()]
    covered = lambda n: [(m, networks[m]) for m in networks if ipaddress.ip_network(m).version == n.version and n.subnet_of(ipaddress.ip_network(m))]
    total = {4: 0, 6: 0}
    for network, *got in rows:
        net = ipaddress.ip_network(network)
        total[net.version] += net.num_addresses
        best = max(covered(net), key=lambda m: ipaddress.ip_network(m[0]).prefixlen)
        assert tuple(got) == mmdb.fields(best[1])
    assert len(rows) == len({r[0] for r in rows})
    assert total == {4: 2**16 + 2**17 + 2**31, 6: 2**112 if version == 6 else 0}
    ips = spark.createDataFrame([(i,) for i in ("8.8.8.8", "8.8.1.1", "41.13.0.1", "9.9.9.9", "2a0c:1::5", "2a0c:1::6", "2a0c:9::")], "broadcast_ip string")
    blocks = readers.read_cidr(spark, path)
    found = {r.broadcast_ip: (r.city, r.asn_org) for r in enrich.enrich_from(ips, blocks, blocks).collect()}
    six = {"2a0c:1::5": ("Host", None), "2a0c:1::6": ("Oslo", None), "2a0c:9::": ("Six", None)}
    assert found == {"8.8.8.8": ("Bé", None), "8.8.1.1": ("A", None), "41.13.0.1": (None, "South Net"), "9.9.9.9": (None, None)} | (six if version == 6 else dict.fromkeys(six, (None, None)))


def test_mmdb_pointers_and_kinds():
    data = b"\x43abc" + b"\x20\x00" + bytes([0x01, 7]) + b"\x04\x08" + b"\x01" * 4 + bytes([0x02, 1]) + bytes([0x44]) + b"wxyz"
    section = mmdb.Section(data, 0)
    assert section.value(0) == ("abc", 4)
    assert section.value(4) == ("abc", 6)
    assert section.value(6) == (True, 8)
    with pytest.raises(ValueError):
        mmdb.Tree(b"not such a file")
