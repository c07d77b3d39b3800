"""The SQL twin of each named query, for DuckDB over the same tables."""

from __future__ import annotations

from tallybook.operators.metrics import TTFT_BOUNDS
from tallybook.plans import catalog as c
from tallybook.plans.fixtures import sql

FEEDS = ("requests_started", "requests_metered", "provider_usage")


def settled(window: int = 300, tick: int | None = None) -> str:
    """One settlement per request, from ranked copies and joins.

    The sweep comes first at the deadline; of copies of one instant the larger total counts.
    """
    deadline = f"s.started_at + INTERVAL {window} SECOND"
    if tick:
        us = f"epoch_us({deadline})"
        deadline = f"make_timestamp(CAST(ceil({us} / {tick}000000.0) AS BIGINT) * {tick}000000)"
    return f"""
WITH fa AS (SELECT request_id, min(ended_at) AS ta FROM requests_metered GROUP BY request_id),
 fb AS (SELECT request_id, min(reported_at) AS tb FROM provider_usage GROUP BY request_id),
 fs AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY started_at) AS rn
   FROM requests_started),
 d AS (SELECT s.*, {deadline} AS deadline FROM fs s WHERE s.rn = 1),
 w0 AS (SELECT coalesce(d.request_id, fa.request_id) AS request_id, d.tenant_id, d.idempotency_key,
     d.started_at, d.deadline, CASE WHEN fa.ta IS NOT NULL AND fb.tb IS NOT NULL
     AND (d.deadline IS NULL OR greatest(fa.ta, fb.tb) < d.deadline)
     THEN greatest(fa.ta, fb.tb) END AS joined_at
   FROM d FULL JOIN fa ON d.request_id = fa.request_id
   LEFT JOIN fb ON coalesce(d.request_id, fa.request_id) = fb.request_id),
 w AS MATERIALIZED (SELECT * FROM w0 WHERE joined_at IS NOT NULL OR deadline IS NOT NULL),
 a AS (SELECT m.*, row_number() OVER (PARTITION BY m.request_id
     ORDER BY m.ended_at DESC, m.prompt_tokens + m.completion_tokens DESC) AS rn
   FROM requests_metered m JOIN w ON m.request_id = w.request_id
   WHERE CASE WHEN w.joined_at IS NULL THEN m.ended_at < w.deadline
     ELSE m.ended_at <= w.joined_at END),
 b AS (SELECT u.*, row_number() OVER (PARTITION BY u.request_id
     ORDER BY u.reported_at DESC, u.prompt_tokens + u.completion_tokens DESC) AS rn
   FROM provider_usage u JOIN w ON u.request_id = w.request_id WHERE u.reported_at <= w.joined_at),
 j AS (SELECT w.request_id,
   CASE WHEN w.joined_at IS NULL THEN w.tenant_id ELSE a.tenant_id END AS tenant_id, coalesce(a.model, 'unknown') AS model, a.terminal_state,
   coalesce(a.idempotency_key, w.idempotency_key) AS idempotency_key,
   coalesce(a.prompt_tokens + a.completion_tokens, 0) AS metered_total,
   b.prompt_tokens + b.completion_tokens AS provider_total,
   b.prompt_tokens + b.completion_tokens - a.prompt_tokens - a.completion_tokens AS delta,
   coalesce(w.joined_at, w.deadline) AS settled_at, w.started_at
   FROM w LEFT JOIN a ON w.request_id = a.request_id AND a.rn = 1
   LEFT JOIN b ON w.request_id = b.request_id AND b.rn = 1)
SELECT request_id, tenant_id, model, terminal_state, idempotency_key, started_at,
  CASE WHEN delta IS NULL THEN 'force_settled' WHEN delta = 0 THEN 'settled'
    ELSE 'settled_with_drift' END AS status,
  metered_total, provider_total,
  CASE WHEN delta IS NULL THEN 0 ELSE delta END AS drift_tokens,
  CASE WHEN delta IS NULL THEN 'unsettled_timeout' WHEN delta = 0 THEN NULL
    WHEN delta < 0 THEN 'provider_underreport'
    WHEN terminal_state = 'client_disconnect' THEN 'client_disconnect_partial'
    WHEN terminal_state = 'budget_exceeded' THEN 'budget_truncated'
    WHEN terminal_state = 'gateway_shutdown' THEN 'gateway_crash_partial'
    ELSE 'tokenizer_mismatch' END AS drift_reason,
  settled_at
FROM j"""


SETTLEMENT = (
    "request_id, tenant_id, model, status, metered_total, provider_total, drift_tokens, "
    "drift_reason, settled_at"
)


def on_ledger(select: str, extra: dict[str, str] | None = None, **options) -> str:
    """``select`` over the ledger; it and what it reads are worked out once, whatever reads them."""
    text = sql(select, *FEEDS, extra={"ledger": settled(**options)} | (extra or {}))
    for name in ("base", *FEEDS, "ledger"):
        text = text.replace(f"{name} AS (", f"{name} AS MATERIALIZED (", 1)
    return text


NOW = f"TIMESTAMP '{c.AS_OF}'"
OPEN = {
    "so_far": "SELECT request_id, min(tenant_id) AS tenant_id, min(started_at) AS started_at "
    f"FROM requests_started WHERE started_at <= {NOW} GROUP BY request_id",
    "rows": f"SELECT * FROM ledger WHERE settled_at <= {NOW}",
    "waiting": "SELECT request_id, tenant_id, started_at FROM so_far "
    "WHERE request_id NOT IN (SELECT request_id FROM rows)",
}


def on_open_ledger(select: str, extra: dict[str, str] | None = None) -> str:
    return on_ledger(select, OPEN | (extra or {}), window=c.DAY)


def later(at: str) -> str:
    """Whether a copy came after the settlement in ``l``."""
    return (
        f"CASE WHEN l.status = 'force_settled' THEN {at} >= l.settled_at "
        f"ELSE {at} > l.settled_at END"
    )


ONCE = {
    "once": "SELECT *, row_number() OVER (PARTITION BY request_id "
    "ORDER BY ended_at, prompt_tokens + completion_tokens) AS rn FROM requests_metered"
}

INDEX = """
SELECT tenant_id, idempotency_key, request_id, uses FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, idempotency_key
      ORDER BY settled_at, request_id) AS rn,
    count(*) OVER (PARTITION BY tenant_id, idempotency_key) AS uses FROM ledger) x WHERE rn = 1"""

REUSED = """
SELECT l.tenant_id, l.idempotency_key, l.request_id, i.request_id AS original_request_id
FROM ledger l JOIN idx i ON l.tenant_id = i.tenant_id AND l.idempotency_key = i.idempotency_key
WHERE l.request_id <> i.request_id"""


def tokens(length: str) -> str:
    return f"(CASE WHEN {length} > 0 THEN greatest(1, {length} // 4) ELSE 0 END)"


# The words of each stream: line number, characters and running characters.
WORDS = f"""
SELECT s.*, i + 2 AS seq, opened_ms + wait_ms + (i + 2) * gap_ms AS arrived_ms,
  length(word) + CASE WHEN i < words - 1 THEN 1 ELSE 0 END AS chars
FROM (SELECT *, unnest(string_split(text, ' ')) AS word,
    unnest(range(words)) AS i FROM streams) s"""
RUNNING = """
SELECT *, CAST(sum(chars) OVER (PARTITION BY request_id ORDER BY seq) AS BIGINT) AS upto FROM words"""
DRAWS = f"""
SELECT * FROM (SELECT tenant_id, request_id, seq, arrived_ms,
  prompt_tokens + {tokens('upto')}
    - greatest(admitted, prompt_tokens + {tokens('(upto - chars)')}) AS tokens FROM running) x
WHERE tokens > 0"""
STREAMED = {"words": WORDS, "running": RUNNING, "draws": DRAWS}
FIRST = """
SELECT request_id, (min(arrived_ms) - min(opened_ms)) / 1000.0::DOUBLE AS s
FROM words WHERE chars > 0 GROUP BY request_id"""


def fold_budget(
    name: str, numbered: str, at: str, capacity: int, refill_per_second: float
) -> dict[str, str]:
    """Draw by draw along each tenant, as a recursion."""
    full, rate = capacity * 1000, int(refill_per_second)
    level = f"least({full}, f.level + ({at.format('n')} - f.since) * {rate})"
    return {
        f"{name}_n": numbered,
        name: f"""
SELECT tenant_id, event_id, rn, {at.format(name + '_n')} AS since, tokens,
  {full} >= tokens * 1000 AS granted,
  CASE WHEN {full} >= tokens * 1000 THEN {full} - tokens * 1000 ELSE {full} END AS level
FROM {name}_n WHERE rn = 1
UNION ALL
SELECT n.tenant_id, n.event_id, n.rn, {at.format('n')}, n.tokens, {level} >= n.tokens * 1000,
  CASE WHEN {level} >= n.tokens * 1000 THEN {level} - n.tokens * 1000 ELSE {level} END
FROM {name} f JOIN {name}_n n ON n.tenant_id = f.tenant_id AND n.rn = f.rn + 1""",
    }


BUDGET = fold_budget(
    "fold",
    "SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY now_ms, event_id) AS rn "
    "FROM budget_draws",
    "{}.now_ms",
    **c.BUDGET,
)


def fold_cuts(capacity: int, refill_per_second: float) -> dict[str, str]:
    """The same along stream draws; a cut request is kept in a list and draws no more."""
    full, rate = capacity * 1000, int(refill_per_second)
    level = f"least({full}, f.level + (n.arrived_ms - f.since) * {rate})"
    skip = "list_contains(f.cut, n.request_id)"
    return {
        "cuts_n": "SELECT *, row_number() OVER (PARTITION BY tenant_id "
        "ORDER BY arrived_ms, request_id, seq) AS rn FROM "
        "(SELECT tenant_id, request_id, seq, arrived_ms, tokens FROM draws UNION ALL "
        "SELECT tenant_id, request_id, -1, opened_ms, admitted FROM streams) both_kinds",
        "cuts": f"""
SELECT tenant_id, rn, request_id, seq, arrived_ms, tokens, arrived_ms AS since,
  {full} >= tokens * 1000 AS granted, FALSE AS skipped,
  CASE WHEN {full} >= tokens * 1000 THEN {full} - tokens * 1000 ELSE {full} END AS level,
  CASE WHEN {full} >= tokens * 1000 THEN CAST([] AS VARCHAR[]) ELSE [request_id] END AS cut
FROM cuts_n WHERE rn = 1
UNION ALL
SELECT n.tenant_id, n.rn, n.request_id, n.seq, n.arrived_ms, n.tokens,
  CASE WHEN {skip} THEN f.since ELSE n.arrived_ms END,
  NOT {skip} AND {level} >= n.tokens * 1000, {skip},
  CASE WHEN {skip} THEN f.level WHEN {level} >= n.tokens * 1000 THEN {level} - n.tokens * 1000
    ELSE {level} END,
  CASE WHEN {skip} OR {level} >= n.tokens * 1000 THEN f.cut
    ELSE list_append(f.cut, n.request_id) END
FROM cuts f JOIN cuts_n n ON n.tenant_id = f.tenant_id AND n.rn = f.rn + 1""",
    }


CUTS = fold_cuts(**c.STREAM_BUDGET)

_LEASE, _TTL = c.CLAIMS["lease_ms"], c.CLAIMS["completed_ttl_ms"]


def _claim(row: str) -> str:
    """Holder, end of the run and expiry after a successful claim."""
    return f"""{row}.request_id, CASE WHEN {row}.released THEN {row}.t_ms
    ELSE {row}.t_ms + {row}.dur_ms END,
  CASE WHEN {row}.released THEN {row}.t_ms WHEN {row}.dur_ms IS NULL THEN {row}.t_ms + {_LEASE}
    ELSE {row}.t_ms + {row}.dur_ms + {_TTL} END"""


# Runs are shorter than the lease here, so a run and its completed record follow without a gap.
CLAIM_FOLD = {
    "claims_n": "SELECT *, row_number() OVER (PARTITION BY tenant_id, idempotency_key "
    "ORDER BY t_ms, event_id) AS rn FROM claim_log",
    "fold": f"""
SELECT n.tenant_id, n.idempotency_key, n.event_id, n.request_id, n.rn, 'claimed' AS outcome, h.*
FROM claims_n n, LATERAL (SELECT {_claim('n')}) h(holder, done_ms, expiry)
WHERE rn = 1
UNION ALL
SELECT n.tenant_id, n.idempotency_key, n.event_id, n.request_id, n.rn,
  CASE WHEN n.t_ms >= f.expiry THEN 'claimed' WHEN n.t_ms >= f.done_ms THEN 'replay'
    ELSE 'in_flight' END,
  CASE WHEN n.t_ms >= f.expiry THEN n.request_id ELSE f.holder END,
  CASE WHEN n.t_ms < f.expiry THEN f.done_ms WHEN n.released THEN n.t_ms ELSE n.t_ms + n.dur_ms END,
  CASE WHEN n.t_ms < f.expiry THEN f.expiry WHEN n.released THEN n.t_ms
    WHEN n.dur_ms IS NULL THEN n.t_ms + {_LEASE} ELSE n.t_ms + n.dur_ms + {_TTL} END
FROM fold f JOIN claims_n n ON n.tenant_id = f.tenant_id
  AND n.idempotency_key = f.idempotency_key AND n.rn = f.rn + 1""",
}

STATE = """
SELECT request_id, tenant_id, CASE WHEN http_status >= 400 OR transport_failed THEN 'provider_error'
  WHEN draw_refused THEN 'budget_exceeded' WHEN cancelled THEN 'gateway_shutdown'
  WHEN client_gone THEN 'client_disconnect' ELSE 'completed' END AS terminal_state
FROM stream_outcomes"""
BILLED = """
SELECT a.request_id, u.tenant_id, u.attempt, u.tokens,
  CASE WHEN u.failed THEN 'provider_error' ELSE 'completed' END AS terminal_state,
  a.failed AND a.tokens = 0 AS retried
FROM attempts a JOIN attempts u ON u.request_id = a.request_id
  AND u.attempt = CASE WHEN a.failed AND a.tokens = 0 THEN 2 ELSE 1 END
WHERE a.attempt = 1"""

MESSAGE = f"""
SELECT conv_id, turn, role, CASE WHEN turn % 3 = 1
  THEN {tokens('length(substring(text, 1, 10))')} + {tokens('length(substring(text, 11))')}
  ELSE {tokens('length(text)')} END AS tokens FROM conversations"""

_SCENARIOS = " UNION ALL ".join(
    f"SELECT '{s.name}' AS scenario, '{s.tenant_pattern}' AS pattern, "
    f"CAST([{', '.join(repr(r) for r in sorted(s.expected_reasons))}] AS VARCHAR[]) AS expected"
    for s in c.SCENARIOS
)
REPORT = {
    "scenarios": _SCENARIOS,
    "plain": "SELECT tenant_id, status, drift_tokens, CASE WHEN drift_reason <> 'tokenizer_mismatch' "
    "THEN drift_reason END AS drift_reason FROM rows",
    "per_reason": "SELECT s.scenario, p.drift_reason, count(*) AS n, "
    "CAST(sum(abs(p.drift_tokens)) AS BIGINT) AS t FROM scenarios s JOIN plain p "
    "ON p.tenant_id LIKE s.pattern WHERE p.drift_reason IS NOT NULL GROUP BY ALL",
    "report": """
SELECT s.scenario, s.expected,
  (SELECT count(*) FROM so_far x WHERE x.tenant_id LIKE s.pattern) AS started,
  (SELECT count(*) FROM plain x WHERE x.tenant_id LIKE s.pattern) AS settled,
  (SELECT count(*) FROM waiting x WHERE x.tenant_id LIKE s.pattern) AS still_pending,
  (SELECT CAST(coalesce(sum(abs(drift_tokens)), 0) AS BIGINT) FROM plain x
    WHERE x.tenant_id LIKE s.pattern AND drift_reason IS NULL) AS unattributed_drift_tokens,
  (SELECT count(*) FROM plain x WHERE x.tenant_id LIKE s.pattern
    AND drift_reason = 'retry_double_count') AS double_counts,
  (SELECT count(*) FROM plain x WHERE x.tenant_id LIKE s.pattern
    AND status = 'force_settled') AS force_settled,
  coalesce((SELECT string_agg(drift_reason || '=' || n, ',' ORDER BY drift_reason)
    FROM per_reason p WHERE p.scenario = s.scenario), '') AS reasons,
  coalesce((SELECT string_agg(drift_reason || '=' || t, ',' ORDER BY drift_reason)
    FROM per_reason p WHERE p.scenario = s.scenario), '') AS drift_tokens_by_reason,
  coalesce((SELECT list(drift_reason ORDER BY drift_reason) FROM per_reason p
    WHERE p.scenario = s.scenario AND NOT list_contains(s.expected, p.drift_reason)), [])
    AS surprises
FROM scenarios s""",
}
CHECK = """
SELECT scenario, CASE WHEN started = 0
  THEN 'no requests were recorded — the load generator did not run'
  ELSE concat_ws('; ',
    CASE WHEN settled <> started THEN 'unaccounted requests: ' || started || ' started, ' || settled
      || ' settled (' || (started - settled) || ' missing)' END,
    CASE WHEN still_pending > 0 THEN still_pending || ' requests still pending past the settlement '
      || 'window — the sweeper did not force-settle them' END,
    CASE WHEN unattributed_drift_tokens > 0
      THEN unattributed_drift_tokens || ' drift tokens carry no reason code' END,
    CASE WHEN double_counts > 0
      THEN double_counts || ' requests were billed twice (retry_double_count)' END,
    CASE WHEN len(surprises) > 0 THEN 'unexpected drift reasons: ['''
      || array_to_string(surprises, ''', ''') || '''] (expected '
      || CASE WHEN len(expected) > 0 THEN '[''' || array_to_string(expected, ''', ''') || ''']'
        ELSE 'none' END || ')' END) END AS failures"""

_BOUNDS = TTFT_BOUNDS
_BUCKETS = " UNION ALL ".join(
    [
        f"SELECT {i} AS i, '{b:g}' AS le, {b}::DOUBLE AS hi, "
        f"{_BOUNDS[i - 1] if i else 0.0}::DOUBLE AS lo, "
        f"(SELECT count(*) FROM first WHERE s <= {b}) AS n"
        for i, b in enumerate(_BOUNDS)
    ]
    + ["SELECT 8, '+Inf', NULL, NULL, (SELECT count(*) FROM first)"]
)


def quantile(name: str, q: float) -> str:
    return f"""
SELECT '{name}' AS quantile,
  (SELECT CASE WHEN b.hi IS NULL THEN 10.0::DOUBLE ELSE b.lo + (b.hi - b.lo) * coalesce(
      ({q}::DOUBLE * t.n - coalesce(p.n, 0)) / nullif(b.n - coalesce(p.n, 0), 0), 1.0) END
    FROM buckets b LEFT JOIN buckets p ON p.i = b.i - 1, buckets t
    WHERE t.i = 8 AND b.n >= {q}::DOUBLE * t.n ORDER BY b.i LIMIT 1) AS estimate"""


_QUANTILES = " UNION ALL ".join(
    quantile(name, q) for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
)


def rate(by: str, where: str, more: str = "") -> str:
    return (
        f"SELECT date_trunc('minute', settled_at) AS minute, {by}, count(*) AS n, "
        f"count(*) / 60.0::DOUBLE AS per_second{more} FROM ledger {where} GROUP BY ALL"
    )


ORACLE: dict[str, str] = {
    "scan_events": sql(
        "SELECT 'requests.started' AS topic, request_id, tenant_id, model, prompt_tokens, "
        "NULL::BIGINT AS completion_tokens, NULL::VARCHAR AS terminal_state, started_at AS at "
        "FROM requests_started UNION ALL "
        "SELECT 'requests.metered', request_id, tenant_id, model, prompt_tokens, completion_tokens, "
        "terminal_state, ended_at FROM requests_metered UNION ALL "
        "SELECT 'provider.usage', request_id, NULL, NULL, prompt_tokens, completion_tokens, NULL, "
        "reported_at FROM provider_usage",
        *FEEDS,
    ),
    "reconcile": on_ledger(f"SELECT {SETTLEMENT} FROM ledger"),
    "attribute": on_ledger(
        """SELECT request_id, tenant_id, terminal_state, metered_total, provider_total,
  CASE WHEN dup THEN 'settled_with_drift' WHEN delta IS NULL THEN 'force_settled'
    WHEN abs(delta) <= 3 THEN 'settled' ELSE 'settled_with_drift' END AS status,
  CASE WHEN dup THEN metered_total WHEN delta IS NULL OR abs(delta) <= 3 THEN 0 ELSE delta END
    AS drift_tokens,
  CASE WHEN dup THEN 'retry_double_count' WHEN delta IS NULL THEN 'unsettled_timeout'
    WHEN abs(delta) <= 3 THEN NULL WHEN delta < 0 THEN 'provider_underreport'
    WHEN terminal_state = 'client_disconnect' THEN 'client_disconnect_partial'
    WHEN terminal_state = 'budget_exceeded' THEN 'budget_truncated'
    WHEN terminal_state = 'gateway_shutdown' THEN 'gateway_crash_partial'
    ELSE 'tokenizer_mismatch' END AS drift_reason
FROM (SELECT a.request_id, a.tenant_id, a.terminal_state,
    a.prompt_tokens + a.completion_tokens AS metered_total,
    b.prompt_tokens + b.completion_tokens AS provider_total,
    b.prompt_tokens + b.completion_tokens - a.prompt_tokens - a.completion_tokens AS delta,
    a.request_id IN (SELECT request_id FROM reused) AS dup
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id
      ORDER BY ended_at DESC, prompt_tokens + completion_tokens DESC) AS rn
    FROM requests_metered) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY request_id
      ORDER BY reported_at DESC, prompt_tokens + completion_tokens DESC) AS rn
    FROM provider_usage) b ON a.request_id = b.request_id AND b.rn = 1
  WHERE a.rn = 1) x""",
        {"idx": INDEX, "reused": REUSED},
    ),
    "sweep": on_ledger(
        f"SELECT {SETTLEMENT} FROM ledger WHERE status = 'force_settled' AND settled_at <= {NOW}",
        tick=30,
    ),
    "settle_first_write": on_ledger(
        f"""SELECT l.request_id, status, metered_total, settled_at,
  1 + (SELECT count(*) FROM requests_metered m WHERE m.request_id = l.request_id
    AND {later('m.ended_at')}) AS attempts
FROM ledger l WHERE settled_at >= {NOW}"""
    ),
    "pending": on_open_ledger("SELECT * FROM waiting"),
    "expired_pending": on_open_ledger(
        f"SELECT * FROM waiting WHERE started_at <= TIMESTAMP '{c.EXPIRY_CUTOFF}' "
        "ORDER BY started_at, request_id"
    ),
    "unaccounted": on_ledger(
        "SELECT request_id, tenant_id FROM ledger WHERE status = 'force_settled'"
    ),
    "drift_events": on_ledger(
        "SELECT request_id, tenant_id, drift_reason AS reason, drift_tokens, status AS detail_status "
        "FROM ledger WHERE status = 'settled_with_drift'"
    ),
    "idempotency_index": on_ledger(INDEX),
    "duplicate_keys": on_ledger("SELECT * FROM reused", {"idx": INDEX, "reused": REUSED}),
    "drift_by_terminal_state": on_ledger(
        "SELECT terminal_state, drift_reason, count(*) AS requests, "
        "CAST(sum(abs(drift_tokens)) AS BIGINT) AS drift_tokens "
        "FROM ledger WHERE drift_reason IS NOT NULL GROUP BY ALL"
    ),
    "duplicates_absorbed": on_ledger(
        "SELECT m.tenant_id, count(*) AS absorbed FROM requests_metered m JOIN ledger l "
        f"ON m.request_id = l.request_id AND {later('m.ended_at')} GROUP BY ALL"
    ),
    "late_usage": on_ledger(
        "SELECT l.request_id, l.status, u.prompt_tokens + u.completion_tokens AS provider_total, "
        "u.reported_at, l.settled_at FROM provider_usage u JOIN ledger l "
        f"ON u.request_id = l.request_id AND {later('u.reported_at')} "
        "WHERE l.status = 'force_settled'"
    ),
    "half_joined": on_open_ledger(
        f"""SELECT 'metered' AS side, count(DISTINCT request_id) AS buffered FROM requests_metered
WHERE ended_at <= {NOW} AND request_id NOT IN (SELECT request_id FROM rows)
UNION ALL
SELECT 'usage', count(DISTINCT u.request_id) FROM provider_usage u
LEFT JOIN rows l ON u.request_id = l.request_id
WHERE u.reported_at <= {NOW} AND (l.settled_at IS NULL OR {later('u.reported_at')})"""
    ),
    "orphan_usage": sql(
        """SELECT request_id, provider_total, first_reported_at FROM (
  SELECT request_id, prompt_tokens + completion_tokens AS provider_total,
    min(reported_at) OVER (PARTITION BY request_id) AS first_reported_at,
    row_number() OVER (PARTITION BY request_id
      ORDER BY reported_at DESC, prompt_tokens + completion_tokens DESC) AS rn
  FROM provider_usage WHERE request_id NOT IN (SELECT request_id FROM requests_metered)) x
WHERE rn = 1""",
        *FEEDS,
    ),
    "tail_replay": sql(
        "SELECT topic, part, pos, request_id FROM (SELECT *, max(pos) OVER "
        "(PARTITION BY topic, part) AS high FROM feed) x WHERE pos >= greatest(0, high + 1 - 60)",
        "feed",
    ),
    "decode_quarantine": sql(
        """SELECT request_id AS key, error,
  CASE WHEN error IS NULL THEN prompt_tokens + completion_tokens END AS total,
  CASE WHEN error IS NULL THEN event_id * 1000000 + 500000 END AS ended_us
FROM (SELECT *, CASE WHEN event_id % 41 = 0 THEN 'not json' WHEN event_id % 43 = 0 THEN 'prompt_tokens'
  WHEN event_id % 47 = 0 THEN 'terminal_state' END AS error FROM base) x""",
        "base",
    ),
    "tenant_scope": on_ledger(
        "SELECT request_id, tenant_id, status FROM ledger WHERE tenant_id LIKE 's1-%'"
    ),
    "scope_counts": on_open_ledger(
        "SELECT (SELECT count(*) FROM rows WHERE tenant_id LIKE 's_-1') AS settled, "
        "(SELECT count(*) FROM waiting WHERE tenant_id LIKE 's_-1') AS pending"
    ),
    "unattributed_drift": on_ledger(
        "SELECT CAST(coalesce(sum(abs(drift_tokens)), 0) AS BIGINT) AS drift_tokens FROM ledger "
        "WHERE tenant_id LIKE 's1-%' AND drift_tokens <> 0 "
        "AND coalesce(drift_reason, 'tokenizer_mismatch') = 'tokenizer_mismatch'"
    ),
    "drift_by_reason": on_ledger(
        "SELECT drift_reason, count(*) AS requests, CAST(sum(abs(drift_tokens)) AS BIGINT) "
        "AS drift_tokens FROM ledger WHERE drift_reason IS NOT NULL GROUP BY ALL"
    ),
    "scenario_report": on_open_ledger(
        "SELECT * EXCLUDE (expected, surprises), CASE WHEN started > 0 "
        "THEN 100.0::DOUBLE * settled / started ELSE 0.0::DOUBLE END AS accounted_pct FROM report",
        REPORT,
    ),
    "scenario_check": on_open_ledger(
        f"SELECT *, failures = '' AS passed FROM ({CHECK} FROM report) x", REPORT
    ),
    "drain_audit": on_open_ledger(
        f"""SELECT settled, pending, double_counts,
  pending = 0 AND double_counts = 0 AND settled >= 55 AS passed
FROM (SELECT (SELECT count(*) FROM rows WHERE tenant_id = '{c.DRAIN_TENANT}') AS settled,
  (SELECT count(*) FROM waiting WHERE tenant_id = '{c.DRAIN_TENANT}') AS pending,
  (SELECT count(*) FROM rows WHERE tenant_id = '{c.DRAIN_TENANT}'
    AND drift_reason = 'retry_double_count') AS double_counts) x"""
    ),
    "settlements_by_status": on_ledger(rate("status", "")),
    "drift_rate": on_ledger(
        rate(
            "drift_reason",
            "WHERE status = 'settled_with_drift'",
            ", CAST(sum(abs(drift_tokens)) AS BIGINT) AS drift_tokens",
        )
    ),
    "requests_by_state": sql(
        "SELECT tenant_id, terminal_state, count(*) AS requests FROM once WHERE rn = 1 GROUP BY ALL",
        "requests_metered",
        extra=ONCE,
    ),
    "tokens_by_tenant_model": sql(
        "SELECT tenant_id, model, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens "
        "FROM once WHERE rn = 1 GROUP BY ALL",
        "requests_metered",
        extra=ONCE,
    ),
    "budget_rejections": sql(
        "SELECT tenant_id, CASE WHEN seq < 0 THEN 'admission' ELSE 'mid_stream' END AS stage, "
        "count(*) AS rejected FROM cuts WHERE NOT granted AND NOT skipped GROUP BY ALL",
        "streams",
        extra=STREAMED | CUTS,
        recursive=True,
    ),
    "idempotency_outcomes": sql(
        "SELECT outcome, count(*) AS claims FROM fold GROUP BY ALL",
        "claim_log",
        extra=CLAIM_FOLD,
        recursive=True,
    ),
    "ttft_buckets": sql(
        f"SELECT le, n AS requests FROM ({_BUCKETS}) x",
        "streams",
        extra={"words": WORDS, "first": FIRST},
    ),
    "ttft_quantiles": sql(
        _QUANTILES, "streams", extra={"words": WORDS, "first": FIRST, "buckets": _BUCKETS}
    ),
    "in_flight": sql(
        """SELECT minute, CAST(sum(up) AS BIGINT) AS opened, CAST(sum(down) AS BIGINT) AS closed,
  CAST(sum(sum(up) - sum(down)) OVER (ORDER BY minute) AS BIGINT) AS open
FROM (SELECT opened_ms // 60000 AS minute, 1 AS up, 0 AS down FROM stream_spans UNION ALL
  SELECT closed_ms // 60000, 0, 1 FROM stream_spans WHERE closed_ms IS NOT NULL) x
GROUP BY minute""",
        "stream_spans",
    ),
    "stream_counters": sql(
        "SELECT tenant_id, 'orphaned_drains' AS counter, count(*) AS n FROM states "
        "WHERE terminal_state = 'client_disconnect' GROUP BY ALL UNION ALL "
        "SELECT tenant_id, 'provider_retries', count(*) FROM billed WHERE retried GROUP BY ALL",
        "stream_outcomes",
        "attempts",
        extra={"states": STATE, "billed": BILLED},
    ),
    "terminal_state": sql(STATE, "stream_outcomes"),
    "request_defaults": sql(
        "SELECT request_id, coalesce(nullif(idempotency_key, ''), 'auto-' || request_id) "
        "AS idempotency_key, coalesce(tenant_id, 'default') AS tenant_id, "
        "coalesce(model, 'unknown') AS model FROM raw_requests",
        "raw_requests",
    ),
    "token_estimate": f"SELECT doc_id, {tokens('length(text)')} AS tokens FROM documents",
    "prompt_tokens": sql(
        "SELECT conv_id, turn, prompt_tokens FROM (SELECT *, CAST(coalesce(sum(tokens) OVER "
        "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
        "AS BIGINT) AS prompt_tokens FROM message) x WHERE role = 'assistant'",
        extra={"message": MESSAGE},
    ),
    "admission_estimate": sql(
        "SELECT conv_id, turn, tokens + CASE WHEN conv_id % 3 = 2 AND conv_id > 0 THEN conv_id * 7 "
        "ELSE 512 END AS estimate FROM message",
        extra={"message": MESSAGE},
    ),
    "meter_streams": sql(
        f"""SELECT request_id, {tokens('length(text)')} AS completion_tokens,
  conv_id % 7 <> 0 AS saw_done,
  CASE WHEN conv_id % 10 = 0 THEN NULL WHEN turn % 4 = 3 THEN 0 ELSE prompt_tokens END
    AS provider_prompt_tokens,
  CASE WHEN conv_id % 10 <> 0 THEN words END AS provider_completion_tokens, FALSE AS exact
FROM streams""",
        "streams",
    ),
    "exact_counts": sql(
        f"""SELECT request_id, len(regexp_extract_all(text, '{c.WORDS_AND_SIGNS}')) AS completion_tokens,
  TRUE AS exact FROM streams""",
        "streams",
    ),
    "running_tokens": sql(
        f"SELECT request_id, seq, {tokens('upto')} AS running_tokens FROM running WHERE chars > 0",
        "streams",
        extra={"words": WORDS, "running": RUNNING},
    ),
    "midstream_draws": sql("SELECT * FROM draws", "streams", extra=STREAMED),
    "stream_cuts": sql(
        "SELECT tenant_id, request_id, seq, arrived_ms, tokens, granted, level // 1000 AS remaining "
        "FROM cuts WHERE NOT skipped",
        "streams",
        extra=STREAMED | CUTS,
        recursive=True,
    ),
    "billable_attempt": sql(BILLED, "attempts"),
    "budget_decisions": sql(
        "SELECT tenant_id, event_id, since AS now_ms, tokens, granted, level // 1000 AS remaining "
        "FROM fold",
        "budget_draws",
        extra=BUDGET,
        recursive=True,
    ),
    "claim_outcomes": sql(
        "SELECT tenant_id, idempotency_key, event_id, request_id, outcome, holder FROM fold",
        "claim_log",
        extra=CLAIM_FOLD,
        recursive=True,
    ),
}
