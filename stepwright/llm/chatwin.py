"""Operator 9. Chat formatting in budgeted windows.

Prefix sums of the turns' tokens choose turn-aligned spans: each window takes
as many further turns as fit beside the system turn and the repeated history.
The system turn (turns of role system before any other) opens every window;
each window but the first repeats up to HISTORY of the turns before its span,
as far as HISTORY_TOKENS allow. Assistant turns of the span are targets; the
repeated ones and all other roles are masked.

Turns are brought together by conversation and sorted; a task reads them in
that order and holds those of which windows can still be made, never a whole
conversation. All conversations of a batch advance by a window at a time, by
search in one array of prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import give_back
from stepwright.llm.packing import tokens

BUDGET = 512
HISTORY = 2
HISTORY_TOKENS = 128
#: Tokens that a turn's frame (role marks, end) adds.
FRAME = 4
#: Turns of an unfinished conversation from which its finished windows are given out.
HELD = 20_000
#: Turns, in windows, of one batch of results.
ROWS_OUT = 20_000
WINDOWS = "conv_id {kind}, window int, place int, turn {turn}, role string, tokens int, repeated boolean, target boolean, window_tokens int, over_budget boolean"
FORMATTED = "conv_id {kind}, window int, turns int, repeated int, tokens int, over_budget boolean, text string, targets string"


def spans(total: np.ndarray, lead: np.ndarray, start: np.ndarray, end: np.ndarray, room: np.ndarray, number: np.ndarray, history: int, history_tokens: int) -> np.ndarray:
    """Rows (conversation, number, history's start, start, stop) of all windows, by conversation.

    total are the prefix sums of the turns' tokens (one more than turns); each conversation has its turns to repeat or to
    take from lead on, those to take from start on, up to end, room tokens beside its system turns, and number its first
    window's. A turn that is too large for an empty window is a window of its own, without history. A conversation
    without a turn to take has one window.
    """
    conv = np.arange(len(start))
    out = [np.stack([conv, number, start, start, start], axis=1)[start >= end]]
    conv = conv[start < end]
    at, w = start[conv], number[conv]
    while len(conv):
        back = at.copy()
        for k in range(1, history + 1):
            step = at - k
            back = np.where((back == step + 1) & (step >= lead[conv]) & (total[at] - total[np.maximum(step, 0)] <= history_tokens), step, back)
        for _ in range(history):  # History yields, oldest first, if it would leave no room for a new turn.
            back += (back < at) & (total[at + 1] - total[back] > room[conv])
        stop = np.clip(np.searchsorted(total, total[back] + room[conv], side="right") - 1, at + 1, end[conv])
        out.append(np.stack([conv, w, back, at, stop], axis=1))
        more = stop < end[conv]
        conv, at, w = conv[more], stop[more], w[more] + 1
    out = np.concatenate(out)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _sorted_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, text: bool) -> DataFrame:
    """conv_id, turn, role, tokens and the text (or its absence) of each turn that has a conversation, together and in order."""
    n = (F.coalesce(tokens(text_col), F.lit(0)) + FRAME).cast("int")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")) if text else F.lit("")
    one = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), n.alias("tokens"), body.alias("text")).where("conv_id is not null")
    return one.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "tokens", "text")


def _stream(batches: Iterator[pa.RecordBatch], budget: int, history: int, history_tokens: int) -> Iterator[tuple]:
    """(rows, conv start, lead, windows, whether the windows' system turns are repeated) of runs of sorted turns; rows are held until their windows are whole."""
    held: pa.Table | None = None
    begun = None  # (windows given out, system turns, turns to repeat) of the conversation that is held, if windows of it were given out

    def cut(rows: pa.Table, last: bool):
        nonlocal held, begun
        conv = rows.column("conv_id").combine_chunks()
        code = np.asarray(conv.dictionary_encode().indices)
        edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
        open_from = int(edge[-2])
        partial = not last and rows.num_rows - open_from >= HELD
        if not last and not partial:
            held, rows, edge = rows.slice(open_from), rows.slice(0, open_from), edge[:-1]
        begin, end = edge[:-1], edge[1:]
        if not len(begin):
            return None
        other = np.asarray(pc.fill_null(pc.not_equal(rows.column("role"), "system"), True).combine_chunks())
        first = np.append(np.flatnonzero(other), rows.num_rows)
        lead = np.minimum(first[np.searchsorted(first, begin)], end)
        start, number = lead.copy(), np.zeros(len(begin), np.int64)
        if begun is not None:
            number[0], lead[0] = begun[0], begun[1]
            start[0] = lead[0] + begun[2]
        size = np.asarray(rows.column("tokens").combine_chunks(), dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        found = spans(total, lead, start, end, np.maximum(budget - (total[lead] - total[begin]), 0), number, history, history_tokens)
        begun_now = None
        if partial:
            # The last conversation goes on: its last window may still grow, and goes on from its start.
            mine = found[:, 0] == len(begin) - 1
            w, at = found[-1, 1], int(found[-1, 3])
            found = found[: int(np.flatnonzero(mine)[-1])]
            back = max(int(lead[-1]), at - history)
            held = pa.concat_tables([rows.slice(int(begin[-1]), int(lead[-1] - begin[-1])), rows.slice(back)])
            begun_now = (w, int(lead[-1] - begin[-1]), at - back)
            if lead[-1] == end[-1]:
                begun_now = None
        elif last:
            held = None
        begun = begun_now
        return rows, begin, lead, found

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            got = cut(pa.concat_tables([held, rows]) if held is not None else rows, False)
            if got:
                yield got
    if held is not None and held.num_rows:
        got = cut(held, True)
        if got:
            yield got


def _taken(begin, lead, found) -> Iterator[tuple[np.ndarray, ...]]:
    """(windows, row of each turn, window of each turn, place, repeated) of parts of the windows of about ROWS_OUT turns."""
    system = (lead - begin)[found[:, 0]]
    n = system + found[:, 4] - found[:, 2]
    part = np.cumsum(n) // ROWS_OUT
    for k in np.unique(part):
        some = np.flatnonzero(part == k)
        f, size, fixed = found[some], n[some], system[some]
        window = np.repeat(np.arange(len(some)), size)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        of_system = place < fixed[window]
        row = np.where(of_system, begin[f[:, 0]][window] + place, f[:, 2][window] + place - fixed[window])
        again = np.where(of_system, f[:, 1][window] > 0, row < f[:, 3][window])
        yield f, row, window, place, again


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn of each window: conv_id, window, place, turn, role, tokens, repeated, target, window_tokens, over_budget.

    Windows and places count from 0. Turns are in the order of (turn, role, tokens), a null turn first; so repeated
    and tied rows have a fixed order. A null role is masked like any role but assistant. A null or empty text has
    only its frame. Rows with a null conv_id belong to no conversation and are left out. A conversation of system
    turns alone is one window. A turn that exceeds the budget by itself is kept whole and marked over_budget. Empty
    tables give no rows; other columns are not looked at.
    """
    kind, turn_kind = turns.schema[conv_col].dataType.simpleString(), turns.schema[turn_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin, lead, found in _stream(batches, budget, history, history_tokens):
            for f, row, window, place, again in _taken(begin, lead, found):
                took = rows.take(pa.array(row)).combine_chunks()
                size = np.asarray(took.column("tokens").combine_chunks())
                total = np.bincount(window, size, minlength=len(f)).astype(np.int32)[window]
                assistant = np.asarray(pc.fill_null(pc.equal(took.column("role"), "assistant"), False).combine_chunks())
                columns = [took.column("conv_id"), f[:, 1][window].astype(np.int32), place.astype(np.int32), took.column("turn"), took.column("role"), took.column("tokens"), again, assistant & ~again, total, total > budget]
                names = ["conv_id", "window", "place", "turn", "role", "tokens", "repeated", "target", "window_tokens", "over_budget"]
                yield from pa.table([pa.chunked_array([pa.array(c)]) if isinstance(c, np.ndarray) else c for c in columns], names=names).to_batches()
        give_back()

    return _sorted_turns(turns, conv_col, turn_col, role_col, text_col, False).mapInArrow(cut, WINDOWS.format(kind=kind, turn=turn_kind))


def formatted(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each window of windows(), as a model is given it: conv_id, window, turns, repeated, tokens, over_budget, text, targets.

    text has for each turn <|role|>, a line break, the turn's text, <|end|> and a line break; <| in a turn's text
    becomes < |, so that a text can't pretend to be a turn; a null role is written as unknown. targets are the spans of
    characters that are to be learned, from:to for each target turn's text and <|end|>, with spaces between; everything
    else is masked. turns and repeated count the window's turns and those that an earlier window has. Turns that tie in
    turn, role and tokens are in the order of their texts. All else is as windows() has it.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    one = _sorted_turns(turns, conv_col, turn_col, role_col, text_col, True)
    front = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"))
    body = F.concat(F.replace("text", F.lit("<|"), F.lit("< |")), F.lit("<|end|>"))
    one = one.select("conv_id", "role", "tokens", F.concat(front, body, F.lit("\n")).alias("piece"), F.length(front).alias("front"), F.length(body).alias("body"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin, lead, found in _stream(batches, budget, history, history_tokens):
            for f, row, window, place, again in _taken(begin, lead, found):
                took = rows.take(pa.array(row)).combine_chunks()
                column = lambda c: np.asarray(took.column(c).combine_chunks(), dtype=np.int64)  # noqa: E731, B023
                edge = np.flatnonzero(place == 0)
                offsets = pa.array(np.append(edge, len(row)), pa.int32())
                total = np.add.reduceat(column("tokens"), edge)
                size = column("front") + column("body") + 1
                before = np.cumsum(size) - size
                at = before - before[edge][window] + column("front")
                target = np.asarray(pc.fill_null(pc.equal(took.column("role"), "assistant"), False).combine_chunks()) & ~again
                span = pc.binary_join_element_wise(pa.array(at[target]).cast(pa.string()), pa.array((at + column("body"))[target]).cast(pa.string()), ":")
                of = pa.array(np.concatenate([[0], np.cumsum(np.bincount(window[target], minlength=len(f)))]), pa.int32())
                text = pc.binary_join(pa.ListArray.from_arrays(offsets, took.column("piece").combine_chunks().cast(pa.string())), "")
                columns = [took.column("conv_id").combine_chunks().take(pa.array(edge)), pa.array(f[:, 1], pa.int32()), pa.array(np.diff(np.append(edge, len(row))), pa.int32()), pa.array(np.bincount(window[again], minlength=len(f)), pa.int32())]
                columns += [pa.array(total, pa.int32()), pa.array(total > budget), text, pc.binary_join(pa.ListArray.from_arrays(of, span), " ")]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "window", "turns", "repeated", "tokens", "over_budget", "text", "targets"])
        give_back()

    return one.mapInArrow(cut, FORMATTED.format(kind=kind))


def oracle_sql() -> str:
    """DuckDB SQL of formatted() over conversations: t[i + 1] is the sum of a conversation's first i turns."""
    earlier = ", ".join(f"s.stop - {k}" for k in range(HISTORY, 0, -1))
    stop = "CAST(least(n, greatest(start + 1, len(list_filter(t, lambda x: x <= t[back + 1] + room)) - 1)) AS BIGINT)"
    return f"""
    WITH RECURSIVE one AS (
      SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS body, coalesce(text, '') AS raw, CAST({FRAME} + CASE WHEN w > 0 THEN w + 1 ELSE 0 END AS INTEGER) AS tokens
      FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\t-\\r ]+')) AS w FROM conversations) WHERE conv_id IS NOT NULL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, tokens, raw) - 1 AS k FROM one),
    conv AS (SELECT conv_id, count(*) AS n, coalesce(min(k) FILTER (WHERE role IS DISTINCT FROM 'system'), count(*)) AS lead_n FROM numbered GROUP BY conv_id),
    sums AS (SELECT conv_id, k, sum(tokens) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM numbered),
    lists AS (SELECT conv_id, n, lead_n, t, greatest({BUDGET} - t[lead_n + 1], 0) AS room
              FROM conv JOIN (SELECT conv_id, list_prepend(0, list(upto ORDER BY k)) AS t FROM sums GROUP BY conv_id) USING (conv_id)),
    steps AS (
      SELECT conv_id, 0 AS w, back, start, {stop} AS stop FROM (SELECT *, lead_n AS back, lead_n AS start FROM lists)
      UNION ALL
      SELECT conv_id, w + 1, back, start, {stop} FROM (
        SELECT s.conv_id, s.w, l.n, l.t, l.room, s.stop AS start,
               coalesce(list_filter([{earlier}], lambda b: b >= l.lead_n AND l.t[s.stop + 1] - l.t[b + 1] <= {HISTORY_TOKENS} AND l.t[s.stop + 2] - l.t[b + 1] <= l.room)[1], s.stop) AS back
        FROM steps s JOIN lists l ON l.conv_id = s.conv_id WHERE s.stop < l.n)),
    taken AS (SELECT s.conv_id, s.w, u.k, u.role, u.body, u.tokens, '<|' || coalesce(u.role, 'unknown') || '|>' || chr(10) AS front, (u.k < lead_n AND s.w > 0) OR (u.k >= lead_n AND u.k < s.start) AS repeated
              FROM steps s JOIN lists l ON l.conv_id = s.conv_id JOIN numbered u ON u.conv_id = s.conv_id AND (u.k < lead_n OR (u.k >= s.back AND u.k < s.stop))),
    placed AS (SELECT *, coalesce(role = 'assistant', false) AND NOT repeated AS target, length(front) + coalesce(sum(length(front) + length(body) + 8)
               OVER (PARTITION BY conv_id, w ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM taken)
    SELECT conv_id, CAST(w AS INTEGER) AS "window", CAST(count(*) AS INTEGER) AS turns, CAST(count(*) FILTER (WHERE repeated) AS INTEGER) AS repeated,
           CAST(sum(tokens) AS INTEGER) AS tokens, sum(tokens) > {BUDGET} AS over_budget, string_agg(front || body || '<|end|>' || chr(10), '' ORDER BY k) AS text,
           coalesce(string_agg(CAST(pos AS BIGINT) || ':' || CAST(pos + length(body) + 7 AS BIGINT), ' ' ORDER BY k) FILTER (WHERE target), '') AS targets
    FROM placed GROUP BY conv_id, w"""
