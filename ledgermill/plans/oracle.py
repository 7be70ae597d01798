"""The catalogue's queries as SQL over the same tables."""

from __future__ import annotations

from ..settings import DEFAULTS, FEATURES
from ..sources.fixtures import CLEAN_SQL, DIRTY_SQL, FB_SQL, GEO_SQL, GT_SQL, MIXED_SQL, MTX_SQL, TX_SQL
from ..sources.synth import synth_sql

US = "(epoch_us({b}) - epoch_us({a}))"


def us(a: str, b: str) -> str:
    return US.format(a=a, b=b)


LINKS = f"""
pass AS (
  SELECT i.dst_wallet AS wallet, i.tx_id AS in_tx, o.tx_id AS out_tx, i.src_wallet AS sender, o.dst_wallet AS recipient, {us('i."timestamp"', 'o."timestamp"')} AS gap_us
  FROM clean i ASOF JOIN clean o ON o.src_wallet = i.dst_wallet AND i."timestamp" <= o."timestamp"
  WHERE {us('i."timestamp"', 'o."timestamp"')} <= {DEFAULTS.pass_through_gap_s * 1_000_000} AND i.amount_btc > 0 AND o.amount_btc / i.amount_btc >= {DEFAULTS.retention}),
bcast AS (
  SELECT DISTINCT a, b FROM (SELECT src_wallet AS a, min(src_wallet) OVER (PARTITION BY broadcast_ip) AS b FROM clean) WHERE a <> b),
coin AS (
  SELECT DISTINCT a, b FROM (SELECT src_wallet AS a, min(src_wallet) OVER (PARTITION BY tx_id) AS b FROM clean) WHERE a <> b)
"""

ENTITIES = f"""
{CLEAN_SQL}, {LINKS},
links AS (SELECT a, b FROM bcast UNION SELECT a, b FROM coin UNION SELECT wallet, sender FROM pass UNION SELECT wallet, recipient FROM pass),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
wallets AS (SELECT src_wallet AS wallet FROM clean UNION SELECT dst_wallet FROM clean),
reach AS (SELECT wallet, wallet AS r FROM wallets UNION SELECT reach.wallet, sym.b FROM reach JOIN sym ON reach.r = sym.a),
ent AS (SELECT wallet, 'entity_' || substr(min(r), 1, {DEFAULTS.entity_id_chars}) AS entity_id FROM reach GROUP BY wallet)
"""

LABELLED = f"""
{ENTITIES},
lab AS (SELECT c.*, s.entity_id AS src_entity, d.entity_id AS dst_entity FROM clean c LEFT JOIN ent s ON c.src_wallet = s.wallet LEFT JOIN ent d ON c.dst_wallet = d.wallet),
touch AS (
  SELECT src_entity AS entity_id, 'sender' AS role, tx_id, "timestamp", amount_btc, broadcast_ip, asn FROM lab
  UNION ALL SELECT dst_entity, 'receiver', tx_id, "timestamp", amount_btc, broadcast_ip, asn FROM lab)
"""

FEATURES_SQL = f"""
{LABELLED},
gaps AS (SELECT *, {us('lag("timestamp") OVER (PARTITION BY entity_id ORDER BY "timestamp", tx_id, role)', '"timestamp"')} / 1e6 AS gap FROM touch),
sums AS (
  SELECT entity_id, count(DISTINCT tx_id) AS tx_count, count(*) FILTER (role = 'receiver') AS fan_in, count(*) FILTER (role = 'sender') AS fan_out,
         avg(amount_btc) AS amount_mean, coalesce(stddev_samp(amount_btc), 0.0) AS amount_std, coalesce(avg(gap), 0.0) AS inter_tx_time_mean, coalesce(stddev_samp(gap), 0.0) AS inter_tx_time_std,
         count(DISTINCT broadcast_ip) AS distinct_ip_count, count(DISTINCT asn) AS distinct_asn_count, {us('min("timestamp")', 'max("timestamp")')} / 1e6 AS span
  FROM gaps GROUP BY entity_id),
feat AS (
  SELECT *, CASE WHEN amount_mean > 0 THEN amount_std / amount_mean ELSE 0.0 END AS amount_cv,
         greatest(least((distinct_ip_count - 1) / greatest(tx_count - 1, 1), 1.0), 0.0) AS network_obfuscation_score, span / greatest(tx_count, 1) AS round_trip_time_mean
  FROM sums)
"""

MOTIFS = f"""
hops AS (SELECT src_entity AS entity_id, {us('lag("timestamp") OVER (PARTITION BY src_wallet ORDER BY "timestamp", tx_id)', '"timestamp"')} AS gap FROM lab),
peel AS (SELECT entity_id, CASE WHEN count(*) FILTER (gap <= {DEFAULTS.peel_gap_s * 1_000_000}) >= {DEFAULTS.peel_min_hops} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS peel_chain_flag FROM hops GROUP BY entity_id),
io AS (SELECT dst_entity AS entity_id, true AS is_in, "timestamp" AS ts FROM lab UNION ALL SELECT src_entity, false, "timestamp" FROM lab),
iosum AS (SELECT entity_id, count(*) FILTER (is_in) AS n_in, count(*) FILTER (NOT is_in) AS n_out, max(ts) FILTER (is_in) AS last_in FROM io GROUP BY entity_id),
nexts AS (SELECT s.entity_id, min(io.ts) AS next_out FROM iosum s JOIN io ON io.entity_id = s.entity_id AND NOT io.is_in AND io.ts >= s.last_in GROUP BY s.entity_id),
fan AS (
  SELECT s.entity_id, CASE WHEN n_in >= {DEFAULTS.fan_threshold} AND n_out >= {DEFAULTS.fan_threshold} AND {us("last_in", "next_out")} <= {DEFAULTS.fan_window_s * 1_000_000} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fan_pattern_flag
  FROM iosum s LEFT JOIN nexts USING (entity_id)),
sgaps AS (SELECT src_entity AS entity_id, {us('lag("timestamp") OVER (PARTITION BY src_entity ORDER BY "timestamp", tx_id)', '"timestamp"')} / 1e6 AS gap FROM lab),
rapid AS (SELECT entity_id, CASE WHEN median(gap) <= {{median}} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rapid_pass_through_flag FROM sgaps WHERE gap IS NOT NULL GROUP BY entity_id),
flags AS (
  SELECT entity_id, coalesce(peel_chain_flag, 0.0) AS p, coalesce(fan_pattern_flag, 0.0) AS f, coalesce(rapid_pass_through_flag, 0.0) AS r
  FROM peel FULL JOIN fan USING (entity_id) FULL JOIN rapid USING (entity_id)),
motif AS (
  SELECT entity_id, (p + f + r) / 3 AS motif_score,
         CASE WHEN p + f + r < 1 THEN 'none' ELSE concat_ws(', ', CASE WHEN p >= 1 THEN 'peel_chain' END, CASE WHEN f >= 1 THEN 'fan_pattern' END, CASE WHEN r >= 1 THEN 'rapid_pass_through' END) END AS motif_reasons
  FROM flags)
"""


def _motifs(median: float) -> str:
    return MOTIFS.replace("{median}", str(median))


NARROW, WIDE = _motifs(DEFAULTS.rapid_median_s), _motifs(28_800.0)

_SCALED = {"isolation_forest_score": "tx_count", "autoencoder_score": "amount_mean", "motif_score": "network_obfuscation_score"}


def _scores(names: tuple[str, ...] = tuple(_SCALED)) -> str:
    cols = ", ".join(f"round(({_SCALED[n]} - min({_SCALED[n]}) OVER ()) / (max({_SCALED[n]}) OVER () - min({_SCALED[n]}) OVER () + 1e-9), 6) AS {n}" for n in names)
    used = {n: DEFAULTS.fusion_weights[n] for n in names}
    total = sum(used.values()) or 1.0
    risk = " + ".join(f"{n} * {w / total!r}::DOUBLE" for n, w in used.items())
    return f"""
score AS (SELECT entity_id, {cols} FROM feat),
ranking AS (
  SELECT *, row_number() OVER (ORDER BY risk_score DESC, entity_id) AS rank, risk_score >= {DEFAULTS.alert_threshold} AS is_alert
  FROM (SELECT *, round(0.0::DOUBLE + {risk}, 9) AS risk_score FROM score))
"""


GEO_LOOKUP = """
located AS (
  SELECT c.*, g.country, g.city, g.latitude, g.longitude, g.asn_org FROM {rows} c LEFT JOIN (
    SELECT ip, country, city, latitude, longitude, asn_org FROM (
      SELECT ip, geo.*, row_number() OVER (PARTITION BY ip ORDER BY prefix DESC, ip_start DESC) AS r
      FROM (SELECT DISTINCT broadcast_ip AS ip, list_reduce(list_transform(string_split(broadcast_ip, '.'), lambda x: CAST(x AS BIGINT)), lambda a, x: a * 256 + x) AS n FROM {rows}) JOIN geo ON n BETWEEN ip_start AND ip_end)
    WHERE r = 1) g ON c.broadcast_ip = g.ip)
"""

ENTITY_GEO = f"""
{LABELLED}, {GEO_SQL}, {GEO_LOOKUP.format(rows="lab")},
gt2 AS (SELECT src_entity AS entity_id, country, city, latitude, longitude FROM located UNION ALL SELECT dst_entity, country, city, latitude, longitude FROM located),
countries AS (SELECT entity_id, count(DISTINCT country) AS distinct_country_count FROM gt2 GROUP BY entity_id),
spots AS (SELECT * FROM gt2 WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
place AS (
  SELECT entity_id, country, city FROM (
    SELECT entity_id, country, city, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, country NULLS LAST, city NULLS LAST) AS r FROM spots GROUP BY entity_id, country, city) WHERE r = 1),
here AS (SELECT s.* FROM spots s JOIN place p ON s.entity_id = p.entity_id AND s.country IS NOT DISTINCT FROM p.country AND s.city IS NOT DISTINCT FROM p.city),
lat AS (SELECT entity_id, latitude FROM (SELECT entity_id, latitude, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, latitude) AS r FROM here GROUP BY entity_id, latitude) WHERE r = 1),
lon AS (SELECT entity_id, longitude FROM (SELECT entity_id, longitude, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, longitude) AS r FROM here GROUP BY entity_id, longitude) WHERE r = 1),
egeo AS (
  SELECT c.entity_id, p.country, p.city, lat.latitude, lon.longitude, c.distinct_country_count
  FROM countries c LEFT JOIN place p USING (entity_id) LEFT JOIN lat USING (entity_id) LEFT JOIN lon USING (entity_id))
"""

GRAPH = f"""
{CLEAN_SQL},
v AS (
  SELECT 'Wallet:' || src_wallet AS id, 'Wallet' AS kind, NULL::TIMESTAMP AS "timestamp", NULL::DOUBLE AS amount_btc, NULL::VARCHAR AS asn FROM clean
  UNION SELECT 'Wallet:' || dst_wallet, 'Wallet', NULL, NULL, NULL FROM clean
  UNION SELECT 'Transaction:' || tx_id, 'Transaction', "timestamp", amount_btc, NULL FROM clean
  UNION SELECT 'IP:' || broadcast_ip, 'IP', NULL, NULL, NULL FROM clean
  UNION SELECT 'ASN:' || asn, 'ASN', NULL, NULL, asn FROM clean),
e AS (
  SELECT 'Wallet:' || src_wallet AS src, 'Transaction:' || tx_id AS dst, 'sends' AS kind, tx_id FROM clean
  UNION ALL SELECT 'Transaction:' || tx_id, 'Wallet:' || dst_wallet, 'receives', tx_id FROM clean
  UNION ALL SELECT 'Transaction:' || tx_id, 'IP:' || broadcast_ip, 'broadcast_from', tx_id FROM clean
  UNION ALL SELECT 'IP:' || broadcast_ip, 'ASN:' || asn, 'belongs_to', tx_id FROM clean)
""".replace("e AS (SELECT *,", "ev AS (SELECT *,").replace("FROM e CROSS JOIN n", "FROM ev CROSS JOIN n")

EVIDENCE = f"""
{GRAPH},
twoway AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
h0 AS (SELECT id FROM v WHERE id = 'Wallet:W0000001'),
h1 AS (SELECT DISTINCT b AS id FROM twoway WHERE a IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h0)),
h2 AS (SELECT DISTINCT b AS id FROM twoway WHERE a IN (SELECT id FROM h1) AND b NOT IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h1)),
near AS (SELECT id, 0::BIGINT AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2),
ev_nodes AS (SELECT v.*, hop FROM v JOIN near USING (id)),
ev_edges AS (SELECT * FROM e WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near))
"""

_TOP = (f"{FEATURES_SQL}, {_scores()}, ".replace("\ne AS (SELECT *,", "\nev AS (SELECT *,").replace("FROM e CROSS JOIN n", "FROM ev CROSS JOIN n") + GRAPH[GRAPH.index("v AS (\n"):]) + f"""
, twoway AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
t0 AS (SELECT DISTINCT r.entity_id, 'Wallet:' || o.wallet AS id FROM ranking r JOIN ent o USING (entity_id) WHERE rank <= {DEFAULTS.explained_top}),
t1 AS (SELECT DISTINCT s.entity_id, b AS id FROM t0 s JOIN twoway ON a = s.id EXCEPT SELECT * FROM t0),
t2 AS (SELECT DISTINCT s.entity_id, b AS id FROM t1 s JOIN twoway ON a = s.id EXCEPT SELECT * FROM t0 EXCEPT SELECT * FROM t1),
around AS (SELECT *, 0::BIGINT AS hop FROM t0 UNION ALL SELECT *, 1 FROM t1 UNION ALL SELECT *, 2 FROM t2)
"""

_VALIDATED = f"""
{TX_SQL}, {DIRTY_SQL},
parsed AS (
  SELECT *, CASE WHEN regexp_matches("timestamp", '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}$') THEN try_cast("timestamp" AS TIMESTAMP) END AS t,
         CASE WHEN regexp_matches(amount_btc, '^-?\\d+$') THEN try_cast(amount_btc AS DOUBLE) END AS amt,
         trim(tx_id, ' ' || chr(9)) AS tid, trim(src_wallet, ' ' || chr(9)) AS sw, trim(dst_wallet, ' ' || chr(9)) AS dw
  FROM dirty),
tagged AS (
  SELECT *, CASE
    WHEN coalesce(tx_id, '') = '' THEN 'missing required field: tx_id'
    WHEN coalesce(asn, '') = '' THEN 'missing required field: asn'
    WHEN t IS NULL THEN 'unparseable timestamp'
    WHEN amt IS NULL THEN 'amount_btc is not numeric'
    WHEN amt <= 0 THEN 'amount_btc must be positive'
    WHEN length(tid) < 4 THEN 'tx_id is too short'
    WHEN length(sw) < 4 THEN 'src_wallet is too short'
    WHEN length(dw) < 4 THEN 'dst_wallet is too short'
    WHEN sw = dw THEN 'self transfer: src_wallet equals dst_wallet' END AS reject_reason
  FROM parsed)
"""

#: XML takes blank elements for missing ones.
_FORMATS = f"""
{_VALIDATED},
ingested AS (
  SELECT * EXCLUDE (reject_reason), CASE WHEN tx_id <> '' AND trim(broadcast_ip) = '' AND TRY_CAST(substr(tx_id, 3) AS BIGINT) % 3 = 2 THEN 'missing required field: broadcast_ip' ELSE reject_reason END AS reject_reason FROM tagged)
"""

_TRUTH = f"""
{{entities}}, {GT_SQL},
gw AS (SELECT unnest(string_split(wallets, ';')) AS wallet, is_illicit, typology FROM gt),
truth AS (
  SELECT e.entity_id, bool_or(coalesce(g.is_illicit, false)) AS is_illicit, coalesce(max_by(g.typology, e.wallet) FILTER (g.is_illicit), 'none') AS typology
  FROM ent e LEFT JOIN gw g USING (wallet) GROUP BY e.entity_id)
"""

_JUDGED = f"""
{_TRUTH.format(entities=FEATURES_SQL)}, {_scores()},
judged AS (SELECT r.entity_id, rank, is_alert, coalesce(is_illicit, false) AS is_illicit, typology FROM ranking r LEFT JOIN truth USING (entity_id))
"""

_WHOLE = {"tx_count", "fan_in", "fan_out", "distinct_ip_count", "distinct_asn_count"}
_TIMES = {"inter_tx_time_mean", "inter_tx_time_std", "round_trip_time_mean"}
_FEATURE_LIST = ", ".join(f if f in _WHOLE else f"round({f}, {3 if f in _TIMES else 6}) AS {f}" for f in FEATURES)
_STANDARD = ", ".join(f"round(({f} - avg({f}) OVER ()) / coalesce(nullif(stddev_pop({f}) OVER (), 0), 1), {{d}}) AS {f}" for f in FEATURES)


def _with(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{body}"


def statements() -> dict[str, str]:
    lookup = GEO_LOOKUP.format(rows="tx")
    top = "CAST(count(*) AS BIGINT)"
    isolation = """
sized AS (SELECT entity_id, 1.0 / count(*) AS raw FROM ent GROUP BY entity_id),
iso AS (SELECT entity_id, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + 1e-9) AS community_isolation_score FROM sized)"""
    return {
        "canonical_tx": _with(TX_SQL, "SELECT * FROM tx"),
        "validate_clean": _with(_VALIDATED, "SELECT tid AS tx_id, t AS \"timestamp\", sw AS src_wallet, dw AS dst_wallet, amt AS amount_btc, trim(broadcast_ip) AS broadcast_ip, asn FROM tagged WHERE reject_reason IS NULL"),
        "validate_rejects": _with(_VALIDATED, "SELECT tx_id, \"timestamp\", src_wallet, dst_wallet, amount_btc, broadcast_ip, asn, reject_reason FROM tagged WHERE reject_reason IS NOT NULL"),
        "reject_reason_counts": _with(_VALIDATED, "SELECT reject_reason, count(*) AS n FROM tagged WHERE reject_reason IS NOT NULL GROUP BY reject_reason"),
        "ingest_formats": _with(_FORMATS, "SELECT tid AS tx_id, t AS \"timestamp\", sw AS src_wallet, dw AS dst_wallet, amt AS amount_btc, trim(broadcast_ip) AS broadcast_ip, asn FROM ingested WHERE reject_reason IS NULL"),
        "ingest_extras": _with(_FORMATS, "SELECT tid AS tx_id, CASE WHEN number % 5 < 3 THEN '0' || (number % 7) END AS memo FROM (SELECT *, CAST(substr(tid, 3) AS BIGINT) AS number FROM ingested WHERE reject_reason IS NULL)"),
        "ingest_format_rejects": _with(_FORMATS, "SELECT reject_reason, count(*) AS n FROM ingested WHERE reject_reason IS NOT NULL GROUP BY reject_reason"),
        "ranking_round_trip": _with(f"{FEATURES_SQL}, {_scores()}", "SELECT * FROM ranking"),
        "feedback_round_trip": _with(FB_SQL, "SELECT entity_id, label, \"timestamp\", count(*) AS n FROM fb GROUP BY ALL"),
        "report_round_trip": _with(_JUDGED, "SELECT unnest(['n_entities_scored', 'n_entities_true_illicit', 'n_entities_flagged', 'true_positives', 'false_positives', 'false_negatives']) AS figure, unnest([count(*), count(*) FILTER (is_illicit), count(*) FILTER (is_alert), count(*) FILTER (is_illicit AND is_alert), count(*) FILTER (NOT is_illicit AND is_alert), count(*) FILTER (is_illicit AND NOT is_alert)]) AS value FROM judged"),
        "union_mixed_sources": _with(f"{TX_SQL}, {MTX_SQL}", "SELECT substr(tx_id, 1, 2) AS source, asn, count(*) AS n, round(sum(amount_btc), 4) AS total FROM (SELECT * FROM tx UNION ALL BY NAME SELECT * FROM mtx) GROUP BY 1, 2"),
        "ip_to_int_public_filter": _with(TX_SQL, "SELECT DISTINCT broadcast_ip AS ip, list_reduce(list_transform(string_split(broadcast_ip, '.'), lambda x: CAST(x AS BIGINT)), lambda a, x: a * 256 + x) AS ip_number, true AS public FROM tx"),
        "geo_range_join": _with(f"{TX_SQL}, {GEO_SQL}, {lookup}", "SELECT tx_id, broadcast_ip, country, city, latitude, longitude, asn_org FROM located"),
        "geo_mixed_versions": _with(MIXED_SQL, "SELECT tx_id, country, city, latitude, longitude, asn_org FROM mixed LEFT JOIN (SELECT * EXCLUDE (version) FROM placed WHERE r = 1) USING (tx_id)"),
        "graph_vertices": _with(GRAPH, "SELECT * FROM v"),
        "graph_edges": _with(GRAPH, "SELECT * FROM e"),
        "edge_kind_counts": _with(GRAPH, "SELECT kind, count(*) AS n FROM e GROUP BY kind"),
        "nodes_by_kind": _with(GRAPH, "SELECT id, kind FROM v WHERE kind = 'IP'"),
        "wallet_tx_list": _with(GRAPH, "SELECT DISTINCT w.src_wallet AS wallet, t.tx FROM (SELECT DISTINCT src_wallet FROM clean) w JOIN (SELECT src AS wid, dst AS tx FROM e WHERE kind = 'sends' UNION SELECT dst, src FROM e WHERE kind = 'receives') t ON t.wid = 'Wallet:' || w.src_wallet"),
        "simple_projection": _with(GRAPH, "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst"),
        "node_degree": _with(GRAPH, "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id"),
        "evidence_2hop_nodes": _with(EVIDENCE, "SELECT id, kind, hop FROM ev_nodes"),
        "evidence_induced_edges": _with(EVIDENCE, "SELECT * FROM ev_edges"),
        "evidence_top": _with(_TOP, "SELECT entity_id, id, kind, hop FROM around JOIN v USING (id)"),
        "evidence_top_edges": _with(_TOP, "SELECT a.entity_id, e.* FROM e JOIN around a ON a.id = e.src JOIN around b ON b.id = e.dst AND a.entity_id = b.entity_id"),
        "co_input_links": _with(MTX_SQL, "SELECT DISTINCT a, b FROM (SELECT src_wallet AS a, min(src_wallet) OVER (PARTITION BY tx_id) AS b FROM mtx) WHERE a <> b"),
        "co_input_merge_counts": _with(MTX_SQL, "SELECT tx_id, count(*) - 1 AS merges FROM mtx GROUP BY tx_id HAVING count(*) > 1"),
        "pass_through_links": _with(f"{CLEAN_SQL}, {LINKS}", "SELECT * FROM pass"),
        "co_broadcast_links": _with(f"{CLEAN_SQL}, {LINKS}", "SELECT * FROM bcast"),
        "wallet_entities": _with(ENTITIES, "SELECT * FROM ent"),
        "entities_in_two_steps": _with(ENTITIES, "SELECT * FROM ent"),
        "entity_sizes": _with(ENTITIES, "SELECT entity_id, count(*) AS wallets FROM ent GROUP BY entity_id"),
        "entity_touches": _with(LABELLED, "SELECT * FROM touch"),
        "entity_features": _with(FEATURES_SQL, f"SELECT entity_id, {_FEATURE_LIST} FROM feat"),
        "entity_gap_stats": _with(FEATURES_SQL, "SELECT entity_id, round(inter_tx_time_mean, 3) AS inter_tx_time_mean, round(inter_tx_time_std, 3) AS inter_tx_time_std FROM feat"),
        "entity_geo": _with(ENTITY_GEO, "SELECT * FROM egeo"),
        "motif_peel": _with(f"{LABELLED}, {NARROW}", "SELECT * FROM peel"),
        "motif_fan": _with(f"{LABELLED}, {NARROW}", "SELECT * FROM fan"),
        "motif_sliding_fan": _with(
            f"{LABELLED}, {NARROW}, slid AS (SELECT entity_id, count(*) FILTER (is_in) OVER w AS i, count(*) FILTER (NOT is_in) OVER w AS o FROM io WINDOW w AS (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 7 DAYS FOLLOWING))",
            f"SELECT entity_id, max(CASE WHEN i >= {DEFAULTS.fan_threshold} AND o >= {DEFAULTS.fan_threshold} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS sliding_fan_flag FROM slid GROUP BY entity_id"),
        "motif_rapid": _with(f"{LABELLED}, {NARROW}", "SELECT * FROM rapid"),
        "motif_rapid_wide": _with(f"{LABELLED}, {WIDE}", "SELECT * FROM rapid"),
        "motif_combined": _with(f"{LABELLED}, {WIDE}", "SELECT entity_id, round(motif_score, 6) AS motif_score, motif_reasons FROM motif"),
        "features_standardized": _with(FEATURES_SQL, f"SELECT entity_id, {_STANDARD.format(d=4)} FROM feat"),
        "minmax_scores": _with(f"{FEATURES_SQL}, {_scores()}", "SELECT * FROM score"),
        "community_isolation": _with(f"{ENTITIES}, {isolation}", "SELECT entity_id, round(community_isolation_score, 6) AS community_isolation_score FROM iso"),
        "fused_ranking": _with(f"{FEATURES_SQL}, {_scores()}", "SELECT * FROM ranking"),
        "alerts": _with(f"{FEATURES_SQL}, {_scores()}", "SELECT entity_id, risk_score, rank FROM ranking WHERE risk_score >= 0.3"),
        "fused_missing_detector": _with(f"{FEATURES_SQL}, {_scores(('isolation_forest_score', 'motif_score'))}", "SELECT * FROM ranking"),
        "ranked_joined": _with(
            f"{FEATURES_SQL}, {_scores()}, {NARROW}, {isolation}, " + ENTITY_GEO.split(LABELLED)[1].lstrip(" ,\n"),
            f"SELECT r.*, {', '.join('f.' + x if x in _WHOLE else f'round(f.{x}, {3 if x in _TIMES else 6}) AS {x}' for x in FEATURES)}, coalesce(m.motif_reasons, 'none') AS motif_reasons, round(i.community_isolation_score, 6) AS community_isolation_score, g.country, g.city, g.latitude, g.longitude, g.distinct_country_count FROM ranking r LEFT JOIN feat f USING (entity_id) LEFT JOIN motif m USING (entity_id) LEFT JOIN iso i USING (entity_id) LEFT JOIN egeo g USING (entity_id)"),
        "explanations": _with(f"{FEATURES_SQL}, {NARROW}", "SELECT entity_id, 'Flagged: ' || distinct_ip_count || ' distinct broadcast IP(s) across ' || tx_count || ' transactions' || CASE WHEN round_trip_time_mean < 3600 THEN ', funds moved onward in ~' || printf('%.1f', round_trip_time_mean / 60) || ' minutes on average' ELSE '' END || CASE WHEN coalesce(motif_reasons, 'none') <> 'none' THEN ' — consistent with a ' || replace(motif_reasons, '_', ' ') || ' typology' ELSE '' END || '.' AS explanation FROM feat LEFT JOIN motif USING (entity_id)"),
        "top_features": _with(
            f"{FEATURES_SQL}, std AS (SELECT entity_id, {_STANDARD.format(d=3)} FROM feat), long AS (" + " UNION ALL ".join(f"SELECT entity_id, '{f}' AS name, {f} AS x FROM std" for f in FEATURES) + ")",
            "SELECT entity_id, string_agg(name, ',' ORDER BY r) AS names FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY abs(x) DESC, name) AS r FROM long) WHERE r <= 3 GROUP BY entity_id"),
        "latest_feedback": _with(FB_SQL, "SELECT entity_id, label, note, \"timestamp\" FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY \"timestamp\" DESC, seq DESC) AS r FROM fb) WHERE r = 1"),
        "feedback_compacted": _with(FB_SQL, "SELECT entity_id, label, note, \"timestamp\" FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY \"timestamp\" DESC, seq DESC) AS r FROM fb) WHERE r = 1"),
        "feedback_ready": _with(FB_SQL, f"SELECT count(*) AS n_labels, count(DISTINCT label) AS n_classes, count(*) >= {DEFAULTS.min_feedback} AND count(DISTINCT label) >= 2 AS enough FROM (SELECT max_by(label, (\"timestamp\", seq)) AS label FROM fb GROUP BY entity_id)"),
        "cluster_truth": _with(_TRUTH.format(entities=ENTITIES), "SELECT * FROM truth"),
        "confusion": _with(_JUDGED, f"""SELECT *, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(p, 6) AS precision, round(r, 6) AS recall
            FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r
            FROM (SELECT {top} FILTER (is_illicit AND is_alert) AS tp, {top} FILTER (NOT is_illicit AND is_alert) AS fp, {top} FILTER (is_illicit AND NOT is_alert) AS fn, {top} AS n_scored, {top} FILTER (is_illicit) AS n_illicit, {top} FILTER (is_alert) AS n_flagged FROM judged))""".replace("CAST(count(*) AS BIGINT) FILTER", "count(*) FILTER").replace("SELECT *, round(CASE", "SELECT tp, fp, fn, n_scored, n_illicit, n_flagged, round(CASE")),
        "precision_at_k": _with(_JUDGED, "SELECT CAST(k AS BIGINT) AS k, round(avg(CAST(is_illicit AS DOUBLE)), 6) AS precision_at_k FROM judged JOIN (VALUES (10), (25), (50), (100)) t(k) ON rank <= k GROUP BY k"),
        "recall_by_typology": _with(_JUDGED, "SELECT typology, round(avg(CAST(is_alert AS DOUBLE)), 6) AS recall FROM judged WHERE is_illicit GROUP BY typology"),
        "typology_options": _with(f"{LABELLED}, {WIDE}", "SELECT DISTINCT trim(unnest(string_split(motif_reasons, ','))) AS typology FROM motif"),
        "alerts_filtered": _with(f"{FEATURES_SQL}, {_scores()}, {WIDE}", "SELECT entity_id, risk_score, motif_reasons FROM ranking LEFT JOIN motif USING (entity_id) WHERE risk_score >= 0.05 AND regexp_matches(motif_reasons, 'peel_chain|fan_pattern')"),
        "located_points": _with(ENTITY_GEO, "SELECT entity_id, latitude, longitude FROM egeo WHERE latitude IS NOT NULL AND longitude IS NOT NULL"),
        "entity_lookup": _with(ENTITIES, "SELECT wallet FROM ent WHERE entity_id = 'entity_W0000000'"),
        "kind_view": _with(EVIDENCE, "SELECT * FROM ev_edges WHERE src IN (SELECT id FROM ev_nodes WHERE kind IN ('Wallet', 'Transaction')) AND dst IN (SELECT id FROM ev_nodes WHERE kind IN ('Wallet', 'Transaction'))"),
        "node_display": _with(
            f"{EVIDENCE}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ev_edges UNION ALL SELECT dst FROM ev_edges) GROUP BY id)",
            "SELECT id, kind, substr(raw, 1, 8) || CASE WHEN length(raw) > 8 THEN '…' ELSE '' END AS label, round(14 + 10 * (coalesce(degree, 0) / (SELECT max(degree) FROM deg)) + CASE WHEN id = 'Wallet:W0000001' THEN 8 ELSE 0 END, 6)::DOUBLE AS size, id = 'Wallet:W0000001' AS is_seed FROM (SELECT *, substr(id, strpos(id, ':') + 1) AS raw FROM ev_nodes) LEFT JOIN deg USING (id)"),
        "node_details": _with(GRAPH, "SELECT kind, substr(id, strpos(id, ':') + 1) AS raw_id, amount_btc, \"timestamp\", asn FROM v"),
        "synthetic_transactions": _with(synth_sql("SELECT c_custkey AS number FROM customer"), "SELECT * FROM stx"),
        "synthetic_truth": _with(synth_sql("SELECT c_custkey AS number FROM customer"), "SELECT * FROM struth"),
        "edge_property_endpoints": _with(GRAPH, "SELECT src AS id FROM e WHERE kind = 'broadcast_from' UNION SELECT dst FROM e WHERE kind = 'broadcast_from'"),
    }
