"""Rows of a stream as columns: blocks of them as bytes, and running values of many rows computed at once.

Python takes a row of a stream in some microseconds, a column of a block in a few nanoseconds a value. The functions give what the message-by-message
loops in the tests give.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}

#: Rows of a partition that are packed at a time.
PACK = 100_000


def names(text: str) -> list[str]:
    """Column names of a schema's text."""
    return [c.split()[0] for c in text.split(", ")]


def schema(text: str) -> pa.Schema:
    return pa.schema([(c.split()[0], TYPES[c.split()[1]]) for c in text.split(", ")])


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def pack_by_key(batches: Iterator[pa.RecordBatch], keys: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of (key, time, columns) as rows of (key, latest time, block of the columns); rows without a key are dropped. Each key below ``keys`` has a
    block, if only an empty one."""
    held: list[pa.RecordBatch] = []
    missing, last = set(range(keys)), None
    for b in batches:
        last = b if b.num_rows else last
        held += [b] if b.num_rows else []
        if sum(x.num_rows for x in held) >= PACK:
            yield from _blocks(held, missing)
            held = []
    if held:
        yield from _blocks(held, missing)
    if missing and last is not None:
        key, time, *rest = last.schema.names
        n, empty = len(missing), packed(pa.Table.from_batches([last]).select(rest).slice(0, 0))
        yield pa.record_batch([pa.array(sorted(missing), last.schema.field(key).type), pa.array([None] * n, last.schema.field(time).type), pa.array([empty] * n, pa.binary())], names=[key, time, "block"])


def _blocks(batches: list[pa.RecordBatch], missing: set[int]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches)
    key, time, *rest = table.column_names
    table = table.filter(pc.is_valid(table[key])).combine_chunks()
    if not table.num_rows:
        return
    found = table[key].combine_chunks().dictionary_encode()
    codes = found.indices.to_numpy()
    table = table.take(pa.array(np.argsort(codes, kind="stable")))
    missing.difference_update(found.dictionary.to_pylist())
    at = 0
    for n in np.bincount(codes, minlength=len(found.dictionary)).tolist():
        part = table.slice(at, n)
        at += n
        top = pa.array([pc.max(part[time]).as_py()], table.schema.field(time).type)
        yield pa.record_batch([part[key].slice(0, 1).combine_chunks(), top, pa.array([packed(part.select(rest))], pa.binary())], names=[key, time, "block"])


def values(table: pa.Table, name: str) -> np.ndarray:
    """A column of numbers; nulls are 0."""
    c = table[name]
    return (c.fill_null(False if pa.types.is_boolean(c.type) else 0) if c.null_count else c).to_numpy()


def known(table: pa.Table, name: str) -> np.ndarray:
    return table[name].is_valid().to_numpy()


def series(column: pa.ChunkedArray) -> Any:
    """The column for a frame, with its nulls."""
    import pandas as pd

    return pd.Series(pd.arrays.ArrowExtensionArray(column)) if column.null_count else column.to_numpy()


def nullable(x: np.ndarray, there: np.ndarray) -> Any:
    """Numbers, null where they aren't there."""
    import pandas as pd

    return pd.Series(pd.arrays.IntegerArray(np.ascontiguousarray(x), ~there))


def in_order(table: pa.Table, order: Sequence[str]) -> pa.Table:
    """Sorted, nulls first; equal rows stay as they come."""
    keys: list[np.ndarray] = []
    for c in reversed(order):
        keys.append(values(table, c))
        if table[c].null_count:
            keys.append(known(table, c))
    return table.take(pa.array(np.lexsort(keys)))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class Lives:
    """Lives of many entities. State, by entity in ascending order: number of the life, its anomalies, its last stage (-1: none) and when, how many stages it has seen,
    and these stages one after the other. Stages are numbers; -1 is a message without one."""

    FIELDS = ("entity", "life", "anomalies", "last", "last_us", "n_seen")

    @staticmethod
    def start() -> dict[str, np.ndarray]:
        x = {f: np.zeros(0, np.int64) for f in Lives.FIELDS}
        return x | {"life": np.zeros(0, np.int32), "last": np.zeros(0, np.int32), "n_seen": np.zeros(0, np.int32), "seen": np.zeros(0, np.int32)}

    @staticmethod
    def step(
        s: dict[str, np.ndarray], entity: np.ndarray, us: np.ndarray, stage: np.ndarray, leaves: np.ndarray, anomalous: np.ndarray, idle_us: int | None, distinct: bool
    ) -> tuple[dict[str, np.ndarray], dict[str, Any]]:
        """The rows are in order of entity, then of time. An exit ends a life, and so does a silence of more than ``idle_us`` after a stage. ``distinct``: a stage counts as seen
        once a life. Returns the state and, by row, ``life``, ``last``, ``anomalies``, ``n_seen``; ``seen``: the stages of the lives that exits end, in their order."""
        n, stage, anomalous = len(entity), stage.astype(np.int32), anomalous.astype(np.int64)
        opens = np.ones(n, bool)
        opens[1:] = entity[1:] != entity[:-1]
        first = np.flatnonzero(opens)
        group = np.cumsum(opens) - 1
        who = entity[first]
        at = np.searchsorted(s["entity"], who)
        hit = at < len(s["entity"])
        hit[hit] = s["entity"][at[hit]] == who[hit]
        old = at[hit]

        def held(f: str, none: int) -> np.ndarray:
            x = np.full(len(who), none, np.int64)
            x[hit] = s[f][old]
            return x

        def back(x: np.ndarray, at_first: Any) -> np.ndarray:
            y = np.empty_like(x)
            y[1:] = x[:-1]
            y[first] = at_first
            return y

        last, left = back(stage, held("last", -1)), back(leaves, False)
        cut = left if idle_us is None else left | ((last >= 0) & (us - back(us, held("last_us", 0)) > idle_us))
        ends = np.cumsum(cut)
        life = held("life", 0)[group] + ends - (ends[first] - cut[first])[group]
        begins = opens | cut
        part = np.cumsum(begins) - 1  # number of the life among these rows
        head = np.flatnonzero(begins)
        goes_on = opens[head] & ~cut[head]
        run = np.cumsum(anomalous)
        total = run + (np.where(goes_on, held("anomalies", 0)[group[head]], 0) - run[head] + anomalous[head])[part]

        kept = np.flatnonzero(goes_on & hit[group[head]])  # lives that the state knows
        ranges = at[group[head[kept]]]
        offsets = np.cumsum(s["n_seen"]) - s["n_seen"]
        seen_part, seen = np.repeat(kept, s["n_seen"][ranges]), s["seen"][_spread(offsets[ranges], s["n_seen"][ranges])]
        parts, stages = np.concatenate([seen_part, part]), np.concatenate([seen, stage])
        if distinct:
            new = np.zeros(len(parts), bool)
            new[np.unique(parts * (int(stages.max()) + 2) + stages + 1, return_index=True)[1]] = True
        else:
            new = np.ones(len(parts), bool)
        fresh = new[len(seen) :]
        n_before = np.bincount(seen_part, minlength=len(head))
        count = np.cumsum(fresh)
        n_seen = count + (n_before - count[head] + fresh[head])[part]
        order = np.argsort(parts[new], kind="stable")
        list_part, lists = parts[new][order], stages[new][order]
        sizes = np.bincount(list_part, minlength=len(head))
        exits = np.flatnonzero(leaves)
        shown = np.zeros(len(head), bool)
        shown[part[exits]] = True
        by_exit = np.split(lists[shown[list_part]], np.cumsum(sizes[shown])[:-1]) if len(exits) else []

        tail = np.append(first[1:], n) - 1
        done, final = leaves[tail], part[tail]
        stays = np.ones(len(s["entity"]), bool)
        stays[old] = False
        now = {
            "entity": who, "life": life[tail] + done, "anomalies": np.where(done, 0, total[tail]), "last": np.where(done, -1, stage[tail]), "last_us": us[tail],
            "n_seen": np.where(done, 0, sizes[final]),
        }
        whole = {f: np.concatenate([s[f][stays], now[f].astype(s[f].dtype)]) for f in Lives.FIELDS}
        open_part = np.zeros(len(head), bool)
        open_part[final[~done]] = True
        flat = np.concatenate([s["seen"][np.repeat(stays, s["n_seen"])], lists[open_part[list_part]]])
        at = np.cumsum(whole["n_seen"]) - whole["n_seen"]
        order = np.argsort(whole["entity"], kind="stable")
        state = {f: x[order] for f, x in whole.items()} | {"seen": flat[_spread(at[order], whole["n_seen"][order])]}
        return state, {"life": life, "last": np.where(cut, -1, last), "anomalies": total, "n_seen": n_seen, "seen": by_exit}


class Learnt:
    """Outcomes that a stage has learnt. State: entity and life of the last ``window`` visits, and the last ``window`` outcomes."""

    @staticmethod
    def start() -> tuple[np.ndarray, ...]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def step(
        s: tuple[np.ndarray, ...], outcome: np.ndarray, entity: np.ndarray, life: np.ndarray, y: np.ndarray, window: int, default: float
    ) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
        """Rows in order; an outcome counts if its entity's life is among the last ``window`` visits when it comes. Returns the state and, by visit, how many
        visits the window holds with it and the mean of the last ``window`` outcomes before it, the default where there are none."""
        who, lives, ys = s
        m, visit = len(who), ~outcome
        number = np.cumsum(visit) + m
        who, lives = np.concatenate([who, entity]), np.concatenate([lives, life])
        visits = np.concatenate([np.arange(1, m + 1), np.where(visit, number, 0)])
        order = np.lexsort((lives, who))
        a, b = who[order], lives[order]
        other = np.ones(len(a), bool)
        other[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        base = np.cumsum(other) * (len(a) + 1)
        latest = np.empty(len(a), np.int64)
        latest[order] = np.maximum.accumulate(base + visits[order]) - base
        counts = outcome & (latest[m:] > 0) & (latest[m:] > number - window)
        total = np.concatenate([[0], np.cumsum(np.concatenate([ys, y[counts]]))])
        k = (len(ys) + np.cumsum(counts))[visit]
        rate = np.where(k > 0, (total[k] - total[np.maximum(k - window, 0)]) / np.maximum(np.minimum(k, window), 1), default)
        kept = np.concatenate([np.ones(m, bool), visit])
        state = who[kept][-window:], lives[kept][-window:], np.concatenate([ys, y[counts]])[-window:]
        return state, np.minimum(number[visit], window), rate


def trailing_mean(before: np.ndarray, x: np.ndarray, window: int) -> np.ndarray:
    """Mean of each value and those before it, ``window`` at most. Each frame is summed by itself, so no error runs on."""
    if not len(x):
        return x
    head = np.zeros(window - 1)
    tail = before[len(before) - min(len(before), window - 1) :]
    head[window - 1 - len(tail) :] = tail
    n = np.minimum(len(tail) + 1 + np.arange(len(x)), window)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([head, x]), window).sum(axis=1) / n
