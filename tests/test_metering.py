"""Token counts off stream lines, prompts, defaults, states and quantiles."""

import json

import pytest
from pyspark.sql import functions as F

from tallybook.functions import tokens
from tallybook.functions.attribution import terminal_state
from tallybook.operators import metering, metrics
from tallybook.operators.skew import running_sum, salted_join


def sse(content, **beside):
    body = {"id": "c-1", "choices": [{"index": 0, "delta": {"content": content}} | beside]}
    return f"data: {json.dumps(body, separators=(',', ':'))}"


def stream(spark, *lines, request="r"):
    return spark.createDataFrame(
        [(request, i, line, 1000 + 10 * i) for i, line in enumerate(lines)],
        "request_id string, seq bigint, line string, arrived_ms bigint",
    )


def meter(spark, *lines, **options):
    return metering.meter_streams(stream(spark, *lines), **options).first()


@pytest.mark.parametrize("cuts", [(), (1,), (3, 4, 9), tuple(range(1, 26))])
def test_how_a_text_is_cut_does_not_matter(spark, cuts):
    text = "tallies of a quiet harbour"
    edges = [0, *cuts, len(text)]
    parts = [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    assert meter(spark, *map(sse, parts)).completion_tokens == len(text) // 4


@pytest.mark.parametrize(
    "line",
    [
        "data: {'single': 1}", ":", "   ", "data: true", 'data: {"choices":7}', "retry: 50",
        'data: {"choices":[{"delta":"x"}]}', "data: null", 'data: {"usage": [1, 2]}',
        'data: {"choices":[{"delta":{}}]}', 'data: {"choices":[]', "data: [[]]",
    ],
)
def test_strange_lines_neither_count_nor_stop(spark, line):
    row = meter(spark, sse("one two three "), line, line, sse("four"))
    assert (row.completion_tokens, row.saw_done) == (4, False)
    assert row.provider_prompt_tokens is None


def test_done_marker_and_whitespace(spark):
    row = meter(spark, "  " + sse("hi") + " \r\n", "  data:   [DONE] \t")
    assert (row.completion_tokens, row.saw_done) == (1, True)


def test_text_with_line_separators_is_one_chunk(spark):
    line = 'data: {"choices":[{"delta":{"content":"ab cd\u0085efgh"}}]}'
    assert meter(spark, line).completion_tokens == 2


def test_last_usage_wins_and_content_beside_it_counts(spark):
    both = json.dumps({
        "choices": [{"delta": {"content": "abcdefgh"}}],
        "usage": {"prompt_tokens": 3, "completion_tokens": 9},
    })
    row = meter(spark, 'data: {"usage": {"prompt_tokens": 1, "completion_tokens": 1}}', "data: " + both)
    assert row.completion_tokens == 2
    assert (row.provider_prompt_tokens, row.provider_completion_tokens) == (3, 9)


def test_report_needs_completion_tokens(spark):
    row = meter(spark, 'data: {"usage": {"prompt_tokens": 4}}')
    assert (row.provider_prompt_tokens, row.provider_completion_tokens) == (None, None)
    row = meter(spark, 'data: {"usage": {"completion_tokens": 4}}')
    assert (row.provider_prompt_tokens, row.provider_completion_tokens) == (0, 4)
    row = meter(spark, 'data: {"usage": {"completion_tokens": 4}}', 'data: {"usage": {}}')
    assert row.provider_completion_tokens is None


def test_tokenizer_hook_sees_the_text_in_order(spark):
    lines = [sse("a b"), sse("c d"), "data: [DONE]"]
    row = meter(spark, *lines, tokenizer=lambda text: len(text.split()))
    assert (row.completion_tokens, row.exact) == (3, True)
    assert meter(spark, "data: [DONE]", tokenizer=len).completion_tokens == 0


def test_ledger_rows_from_metered_streams(spark):
    counts = metering.meter_streams(stream(spark, sse("abcdefgh"), 'data: {"usage": {"completion_tokens": 5}}'))
    facts = spark.createDataFrame(
        [("r", "k", "t", "m", 7, "completed", 9), ("silent", "k2", "t", "m", 7, "provider_error", 9)],
        "request_id string, idempotency_key string, tenant_id string, model string, "
        "prompt_tokens bigint, terminal_state string, ended_at bigint",
    )
    a = {r.request_id: r.completion_tokens for r in metering.metered_rows(counts, facts).collect()}
    b = [(r.request_id, r.completion_tokens) for r in metering.usage_rows(counts, facts).collect()]
    assert a == {"r": 2, "silent": 0} and b == [("r", 5)]


@pytest.mark.parametrize("block", [1, 2, 100])
def test_running_count_after_every_line(spark, block):
    lines = stream(spark, sse("ab"), "data: [DONE]", sse("cdef"), sse("ghijkl"))
    rows = metering.running_tokens(lines, block=block).orderBy("seq").collect()
    assert [r.running_tokens for r in rows] == [1, 1, 1, 3]
    assert [r.previous_tokens for r in rows] == [0, 1, 1, 1]


def test_each_model_has_its_own_counter(spark):
    """A model without a tokenizer is estimated and not exact; prompts use the same hook."""
    words = {"spaced": lambda text: len(text.split())}
    lines = spark.createDataFrame(
        [("a", 0, sse("one two three"), 0), ("b", 0, sse("one two three"), 0), ("c", 0, sse("abcd"), 0)],
        "request_id string, seq bigint, line string, arrived_ms bigint",
    )
    models = spark.createDataFrame([("a", "spaced"), ("b", "plain")], "request_id string, model string")
    found = metering.meter_streams(lines, counter_for=words.get, models=models).collect()
    assert {(r.request_id, r.completion_tokens, r.exact) for r in found} == {
        ("a", 3, True), ("b", 3, False), ("c", 1, False),
    }
    with pytest.raises(ValueError):
        metering.meter_streams(lines, counter_for=words.get)

    body = json.dumps({"messages": [
        {"content": "p q r s t"}, {"content": [{"text": "u v"}, {"image": 1}, 7, {"text": None}]}, {}, {"content": 5},
    ]})
    bodies = spark.createDataFrame([(body, "spaced"), ("{", "spaced"), (None, None)], "body string, model string")
    counted = tokens.model_counter(words.get)(tokens.prompt_texts(F.col("body")), F.col("model"))
    got = bodies.select(counted.alias("n")).select("n.*").collect()
    assert [tuple(r) for r in got] == [(7, True), (0, True), (0, False)]


def test_midstream_draws_only_the_overshoot(spark):
    lines = stream(spark, sse("x" * 40), sse("x" * 40), sse("x" * 40))
    facts = spark.createDataFrame(
        [("r", "t", 5, 17)],
        "request_id string, tenant_id string, prompt_tokens bigint, admitted bigint",
    )
    rows = metering.midstream_draws(lines, facts).orderBy("seq").collect()
    assert [(r.seq, r.tokens) for r in rows] == [(1, 8), (2, 10)]


def test_first_token_time(spark):
    facts = spark.createDataFrame([("r", 900)], "request_id string, opened_ms bigint")
    lines = stream(spark, ": keep-alive", sse(""), sse("a"), sse("b"))
    assert metering.first_tokens(lines, facts).first().ttft_seconds == 0.12


@pytest.mark.parametrize(
    ("messages", "count"),
    [
        ([{"role": "user", "content": "hello there friend"}], 4),
        ([{"content": "ab"}, {"content": "cd"}], 2),
        ([{"content": [{"type": "text", "text": "abcdefgh"}, {"type": "image_url"}, "bare", 5]}], 2),
        ([{"content": None}, {"content": 12345678}, {"content": {"text": "abcdefgh"}}, {}], 0),
        ([{"content": "[1, 2, 3, 4, 5, 6]"}], 4),
        ([{"content": ""}], 0),
        ([{"content": []}], 0),
        ([], 0),
    ],
)
def test_prompt_tokens(spark, messages, count):
    frame = spark.createDataFrame([(json.dumps({"model": "m", "messages": messages}),)], "body string")
    assert frame.select(tokens.prompt_tokens(F.col("body"))).first()[0] == count
    assert spark.createDataFrame([("{}",)], "body string").select(
        tokens.prompt_tokens(F.col("body"))
    ).first()[0] == 0


@pytest.mark.parametrize(("declared", "estimate"), [(None, 522), (0, 522), (7, 17)])
def test_admission_estimate(spark, declared, estimate):
    frame = spark.createDataFrame([(10, declared)], "p bigint, m bigint")
    assert frame.select(tokens.admission_estimate(F.col("p"), F.col("m"))).first()[0] == estimate


@pytest.mark.parametrize(
    ("outcome", "state"),
    [
        ((200, False, False, False, False), "completed"),
        ((500, False, False, False, True), "provider_error"),
        ((200, True, False, False, True), "provider_error"),
        ((200, False, True, False, True), "budget_exceeded"),
        ((200, False, False, True, True), "gateway_shutdown"),
        ((200, False, False, False, True), "client_disconnect"),
    ],
)
def test_terminal_state(spark, outcome, state):
    names = ["status", "failed", "refused", "cancelled", "gone"]
    frame = spark.createDataFrame([outcome], "status int, " + " boolean, ".join(names[1:]) + " boolean")
    assert frame.select(terminal_state(*[F.col(n) for n in names])).first()[0] == state


@pytest.mark.parametrize(
    ("attempts", "used"),
    [
        ([(1, 5, False)], (1, 5, "completed", False)),
        ([(1, 0, True), (2, 4, False)], (2, 4, "completed", True)),
        ([(1, 3, True), (2, 4, False)], (1, 3, "provider_error", False)),
        ([(1, 0, True), (2, 0, True), (3, 4, False)], (2, 0, "provider_error", True)),
    ],
)
def test_billable_attempt(spark, attempts, used):
    frame = spark.createDataFrame(
        [("r", "t", *a) for a in attempts],
        "request_id string, tenant_id string, attempt int, tokens bigint, failed boolean",
    )
    row = metering.billable_attempt(frame).first()
    assert (row.attempt, row.tokens, row.terminal_state, row.retried) == used


@pytest.mark.parametrize(
    ("values", "q", "want"),
    [([0.02] * 10, 0.5, 0.025), ([20.0], 0.5, 10.0), ([0.3, 0.3, 3.0, 3.0], 0.75, 3.5)],
)
def test_quantile_interpolates_inside_its_bucket(spark, values, q, want):
    frame = spark.createDataFrame([(v,) for v in values], "ttft_seconds double")
    row = metrics.ttft_quantiles(frame, quantiles=[q]).first()
    assert row.estimate == pytest.approx(want)


def test_no_observations_no_quantile(spark):
    frame = spark.createDataFrame([], "ttft_seconds double")
    assert metrics.ttft_quantiles(frame, quantiles=[0.5]).first().estimate is None


def test_in_flight_counts_open_streams(spark):
    frame = spark.createDataFrame(
        [(0, 70_000), (10_000, None), (61_000, 62_000)], "opened_ms bigint, closed_ms bigint"
    )
    rows = metrics.in_flight(frame).orderBy("minute").collect()
    assert [tuple(r) for r in rows] == [(0, 2, 0, 2), (1, 1, 2, 1)]


def skewed(spark, n=12_000):
    """A third of all rows share one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 900))
    return spark.range(n).select(key.alias("key"), F.col("id").alias("n"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    rows = skewed(spark)
    facts = rows.where("key <> 'k7'").groupBy("key").agg(F.max("n").alias("top"))
    got = salted_join(rows, facts, ["key"], how, fanout=8)
    want = rows.join(facts, "key", how)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_running_sum_over_blocks_equals_a_plain_loop(spark):
    rows = skewed(spark, 3_000)
    got = running_sum(rows, ["key"], "n", {"total": F.col("n")}, block=64).collect()
    totals, want = {}, {}
    for row in sorted(rows.collect(), key=lambda r: r.n):
        totals[row.key] = totals.get(row.key, 0) + row.n
        want[row.n] = totals[row.key]
    assert {r.n: r.total for r in got} == want
