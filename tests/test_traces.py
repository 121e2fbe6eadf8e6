"""Trace, conversation and evaluation operators on small hand-made logs."""

import inspect

from pyspark.sql import functions as F

from roomtrace import constants as K
from roomtrace.operators import conversation as CV
from roomtrace.operators import evaluate as EV
from roomtrace.operators import traces as TR

STEP = "trace_id bigint, step int, question string, raw_output string, observation string"
SEARCH = 'Thought: a\nAction: search_listings["Nam Từ Liêm", 4000000, 7]'


def _classified(spark, rows, intent=None):
    return TR.classify_steps(spark.createDataFrame(rows, STEP), intent)


def test_recorded_trace_is_one_search_then_final(spark):
    seen = "Tìm thấy 1 tin (mới nhất trước):\n  pr710215 | 3.9 triệu/tháng | 25m2 | Nam Từ Liêm | đăng 3 ngày trước | khép kín"
    steps = _classified(spark, [
        (1, 1, "Tìm phòng", SEARCH + "\nObservation: bịa", seen),
        (1, 2, "Tìm phòng", "Thought: đủ.\nFinal Answer: 1. Mã tin pr710215.", None)])
    assert [(r.outcome, r.tool) for r in steps.orderBy("step").collect()] == [
        ("runnable", "search_listings"), ("final", None)]
    assert [tuple(r) for r in TR.summarize_traces(steps).collect()] == [(1, "final", 2, 1, "1. Mã tin pr710215.")]
    assert EV.check_grounding(steps).first().grounded


def test_order_of_step_tests(spark):
    rows = [
        (1, 1, "đặt lịch", 'Action: book_viewing["a"]', ""), (2, 1, "tìm", 'Action: book_viewing["a"]', ""),
        (3, 1, "tìm", "Action: nope[]", ""), (4, 1, "tìm", "nghĩ", ""), (5, 1, "tìm", "Final Answer: x\nAction: nope[]", ""),
        (6, 1, "tìm", "[X Error]: Final Answer: y", ""), (7, 1, "tìm", 'Action: get_listing_details["a"]', ""),
        (8, 7, "tìm", "Final Answer: too late", ""), (9, 1, "tìm", None, "")]
    got = {r.trace_id: r for r in _classified(spark, rows).collect()}
    assert {t: r.outcome for t, r in got.items()} == {
        1: "wrong_arguments", 2: "write_refused", 3: "unknown_tool", 4: "malformed_action", 5: "final",
        6: "provider_error", 7: "runnable", 9: "malformed_action"}
    assert got[2].refusal == K.OBS_WRITE_REFUSED and got[4].refusal == K.OBS_MALFORMED_ACTION
    assert got[3].refusal.startswith("LỖI: không có công cụ tên 'nope'") and got[5].refusal is None


def test_intent_can_come_from_the_conversation(spark):
    rows = [(1, 1, "căn rẻ nhất ấy", 'Action: book_viewing["a", "b", "c", "d"]', "")]
    assert _classified(spark, rows).first().outcome == "write_refused"
    assert _classified(spark, rows, F.lit(True)).first().outcome == "runnable"


def test_wrong_argument_texts_are_pythons(spark):
    namespace = {}
    for name, _, _, _, signature in K.TOOLS:
        exec(f"def {name}{signature}: pass", namespace)  # our own signature texts
    rows, want = [], {}
    for t, (name, required, optional, _, signature) in enumerate(K.TOOLS):
        for n in range(7):
            args = [f"a{i}" for i in range(n)]
            rows.append((t * 10 + n, 1, "book", f"Action: {name}[{', '.join(args)}]", ""))
            try:
                namespace[name](*args)
                want[t * 10 + n] = None
            except TypeError as error:
                want[t * 10 + n] = f"LỖI: gọi sai tham số cho '{name}' ({error}). Chữ ký đúng: {name}{signature}."
        assert str(inspect.signature(namespace[name])) == signature
    assert {r.trace_id: r.refusal for r in _classified(spark, rows).collect()} == want


def test_trace_outcomes(spark):
    def trace(t, outputs):
        return [(t, i, "q", o, f"obs{i}") for i, o in enumerate(outputs, 1)]

    rows = (trace(1, ["x"] * 6) + trace(2, ["x"] * 3) + trace(3, ["x", "[A Error]: dead ", "Final Answer: no"])
            + trace(4, [SEARCH] * 5 + ["Final Answer: yes", "x"]) + trace(5, ["x"] * 8))
    steps = _classified(spark, rows)
    got = {r.trace_id: (r.outcome, r.steps, r.calls, r.answer) for r in TR.summarize_traces(steps).collect()}
    cap = K.MAX_ITERATIONS_TEXT % 6
    assert got == {1: ("max_iterations", 6, 0, cap), 2: ("open", 3, 0, None), 3: ("provider_error", 2, 0, "[A Error]: dead"),
                   4: ("final", 6, 5, "yes"), 5: ("max_iterations", 6, 0, cap)}
    texts = {(r.trace_id, r.step): r.transcript for r in TR.transcript_at(steps, F.lit("H\n")).collect()}
    assert texts[2, 1] == "H\n" and texts[2, 3] == "H\nx\nObservation: obs1\nx\nObservation: obs2\n"
    assert (3, 3) not in texts


def test_attempts(spark):
    busy = "[API Error]: 503"
    rows = [(1, 1, 1, busy), (1, 1, 2, "ok"), (1, 1, 3, "late"), (2, 1, 1, busy), (2, 1, 2, busy), (2, 1, 3, busy),
            (3, 1, 1, busy), (4, 1, 1, "[API Error]: bad key"), (5, 1, 1, None)]
    got = TR.resolve_attempts(spark.createDataFrame(rows, "trace_id int, step int, attempt int, raw_output string"))
    assert {r.trace_id: (r.raw_output, r.attempt, r.needs_retry) for r in got.collect()} == {
        1: ("ok", 2, False), 2: (busy, 3, False), 3: (None, None, True), 4: ("[API Error]: bad key", 1, False), 5: ("", 1, False)}


def test_checks_find_planted_faults(spark):
    check = "Action: check_viewing_slots['p', '2026-07-28']"
    book = 'Action: book_viewing["p", "2026-07-28", "14:00", "n"]'
    rows = [(1, 1, "book", check, "slots"), (1, 2, "book", book, "ok"), (1, 3, "book", "Final Answer: pr5", ""),
            (2, 1, "book", book, "pr7"), (2, 2, "book", book, "pr7"), (2, 3, "book", "Final Answer: pr7 pr8 pr7", ""),
            (3, 1, "q", "Final Answer: none", "")]
    steps = _classified(spark, rows)
    first = {(r.trace_id, r.step): r.checked_first for r in EV.check_slot_before_book(steps).collect()}
    assert first == {(1, 2): True, (2, 1): False, (2, 2): False}
    assert [(r.trace_id, r.tool, r.times) for r in EV.find_repeated_actions(steps).collect()] == [(2, "book_viewing", 2)]
    grounding = {r.trace_id: r.ungrounded for r in EV.check_grounding(steps).collect()}
    assert grounding == {1: ["pr5"], 2: ["pr8"], 3: []}
    expected = spark.createDataFrame(
        [(1, ["check_viewing_slots", "book_viewing"]), (2, ["check_viewing_slots", "book_viewing"]), (3, []), (4, ["x"])],
        "trace_id bigint, expected array<string>")
    paths = {r.trace_id: r.follows_path for r in EV.check_tool_path(steps, expected).collect()}
    assert paths == {1: True, 2: False, 3: True, 4: False}


def _segments(spark, turns):
    rows = [("c", i * 7, q, a) for i, (q, a) in enumerate(turns)]
    return CV.session_segments(spark.createDataFrame(rows, "conv_id string, turn int, question string, answer string"))


def test_commands_and_memory(spark):
    turns = [("đặt lịch", "a0"), ("/gon", None), ("/bot  chi phí", "a1"), ("/bot", None), ("fails", None), ("b", "a2"),
             (" /quen", None), ("c", "a3"), ("  ", None)]
    rows = _segments(spark, turns).orderBy("turn").collect()
    assert [r["query"] for r in rows] == ["đặt lịch", None, "chi phí", None, "fails", "b", None, "c", None]
    assert [r["mode"] for r in rows] == ["agent", None, "baseline", None, "agent", "agent", None, "agent", None]
    assert [r.segment_id for r in rows] == [0] * 6 + [1] * 3
    assert [r.position for r in rows if r["query"]] == [0, 1, 2, 2, 0]


def test_intent_lasts_three_remembered_turns(spark):
    turns = [("đặt lịch", "a")] + [("fails", None)] * 3 + [("x", "a")] * 5
    got = [r.intent_in_context for r in CV.intent_in_context(_segments(spark, turns)).orderBy("turn").collect()]
    assert got == [True] + [True] * 3 + [True] * 3 + [False] * 2


def test_a_booking_asked_for_a_turn_earlier_is_not_refused(spark):
    turns = [("xin chào", "a"), ("đặt lịch giúp tôi", "a"), ("căn rẻ nhất ấy", "a")] + [("x", "a")] * 4
    questions = CV.intent_in_context(_segments(spark, turns))  # turns 0, 7, 14 ...
    call = 'Action: book_viewing["pr1", "2026-07-28", "14:00", "An"]'
    places = [("c", 14), ("c", 20), ("c", 0), ("c", -1), ("c", 6), ("c", 28), ("c", 35), ("c", 10**9), ("d", 14), (None, 14), ("c", None)]
    rows = [(i, 1, "căn rẻ nhất ấy", call, None, *p) for i, p in enumerate(places)]
    rows += [(100 + i, 1, "ĐẶT LỊCH nhé", call, None, *p) for i, p in enumerate([("c", 0), (None, None), ("d", 1)])]
    steps = spark.createDataFrame(rows, "trace_id int, step int, question string, raw_output string, observation string, conv_id string, asked_at int")
    judged = TR.classify_calls(TR.parse_steps(CV.intent_of_steps(steps, questions)), F.col("intent")).collect()
    allowed = {r.trace_id for r in judged if r.call_outcome == "runnable"}
    assert len(judged) == len(rows) and allowed == {0, 1, 5, 100, 101, 102}
    assert {r.call_outcome for r in judged if r.trace_id not in allowed} == {"write_refused"}


def test_history_keeps_ten_turns_and_cuts_answers(spark):
    turns = [(f"q{i}", "  " + "x" * (700 + i % 2) + " ") for i in range(13)]
    rows = CV.history_block(_segments(spark, turns)).orderBy("turn").collect()
    assert rows[0].history == ""
    last = rows[-1].history
    lines = last.split("\n")
    assert lines[0] == K.HISTORY_HEADER and last.endswith("\n") and len(lines) == 1 + 30 + 1
    assert lines[1:4] == ["[Lượt 1]", "Người dùng: q2", "Trợ lý: " + "x" * 700]
    assert lines[6] == "Trợ lý: " + "x" * 700 + " [...]" and lines[29] == "Người dùng: q11"


def test_prompts(spark):
    turns = [("/bot hello", "a"), ("/bot again", "b"), ("next", "c")]
    rows = CV.assemble_prompts(CV.history_block(_segments(spark, turns)), "T {today} {weekday} {tomorrow}", "2026-07-27")
    prompts = [r.prompt for r in rows.orderBy("turn").collect()]
    assert prompts[0] == "hello" and prompts[1].endswith("Câu hỏi: again") and prompts[1].startswith(K.HISTORY_HEADER)
    assert prompts[2].startswith("T 2026-07-27 Thứ Hai 2026-07-28\n" + K.HISTORY_HEADER)
    assert prompts[2].endswith("Câu hỏi: next\n")
