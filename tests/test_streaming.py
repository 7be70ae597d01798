from __future__ import annotations

from ledgermill.streaming import monitor


def test_feed_to_links(spark, tmp_path):
    rows = ["tx_id,timestamp,src_wallet,dst_wallet,amount_btc,broadcast_ip,asn"]
    rows += ["t001,2026-01-01T00:00:00,AAAA,BBBB,10,1.1.1.1,AS1", "t002,2026-01-01T00:05:00,BBBB,CCCC,9,1.1.1.2,AS1", "t003,2026-01-01T00:06:00,BBBB,DDDD,9,1.1.1.2,AS1", "bad,x,BBBB,DDDD,9,1.1.1.2,AS1"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(rows) + "\n")
    clean, rejected = monitor.clean_feed(monitor.read_feed(spark, str(tmp_path / "in")))
    for name, df, mode in (("links", monitor.pass_through_candidates(clean), "append"), ("bursts", monitor.send_bursts(clean, least=2), "update"), ("rejects", rejected, "append")):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
    found = monitor.earliest(spark.table("links")).collect()
    assert [(r.in_tx, r.out_tx) for r in found] == [("t001", "t002")]
    assert spark.table("bursts").where("src_wallet = 'BBBB' and sends = 2").count() > 0
    assert spark.table("rejects").count() == 1
