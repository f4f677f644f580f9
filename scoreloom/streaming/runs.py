"""How runs stand while their answers arrive: state by model, ended by a timer when a model falls silent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.inference import ROUND_CONTEXTS

STATUS_SCHEMA = (
    "model_name string, total_questions bigint, completed_answers bigint, error_count bigint, prompt_min int, prompt_median int, prompt_max int, "
    "total_seconds double, average_seconds double, context_status string, run_status string, ended boolean"
)
_TOTALS = "total bigint, ok bigint, errors bigint, seconds double, timed bigint, num_ctx int, sent int, last bigint"
_EMPTY = (0, 0, 0, 0.0, 0, 0, 0, 0)
#: Neighbouring question numbers that share an entry of state, as places (two bytes each) while few, else as bits; and
#: entries held before they are written.
SHARED, HELD = 4096, 1 << 14


def places_of(packed: bytes) -> np.ndarray:
    """Which of SHARED places an entry has, as flags."""
    flags = np.zeros(SHARED, bool)
    if len(packed) == SHARED // 8:
        return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
    flags[np.frombuffer(packed, "<u2")] = True
    return flags


def packed_places(flags: np.ndarray) -> bytes:
    at = np.flatnonzero(flags)
    return at.astype("<u2").tobytes() if 2 * len(at) < SHARED // 8 else np.packbits(flags).tobytes()


def run_status_of(completed: int, errors: int, total: int) -> str:
    """As run_status, for numbers."""
    if not completed:
        return "failed"
    return "runtime_unstable" if errors and errors >= max(1, total // 3) else "completed_with_errors" if errors else "completed"


def context_status_of(counts: dict[int, int], sent: int, num_ctx: int) -> tuple[str, tuple[int, float, int] | None]:
    """The context's status from how often each number of prompt tokens came; and their least, median and most."""
    if not counts:
        return "failed", None
    values, n, seen, middle = sorted(counts), sum(counts.values()), 0, []
    for v in values:
        before, seen = seen, seen + counts[v]
        middle += [v for place in {(n - 1) // 2, n // 2} if before <= place < seen]
    median = sum(middle) / len(middle)
    cut = sent > 0 and median < 0.85 * sent or values[0] == values[-1] < num_ctx and values[0] in ROUND_CONTEXTS
    return "truncated_context" if cut else "valid_full_context", (values[0], median, values[-1])


class _Run(StatefulProcessor):
    """State of a model: totals, how often each number of prompt tokens came, and the questions that were counted."""

    def __init__(self, silent_ms: int, expected: int):
        self.silent_ms, self.expected = silent_ms, expected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", _TOTALS)
        self.tokens = handle.getMapState("tokens", "tokens int", "times bigint")
        self.asked = handle.getMapState("asked", "part long", "places binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        total, ok, errors, seconds, timed, num_ctx, sent, last = self.totals.get() if self.totals.exists() else _EMPTY
        times: dict[int, int] = {}
        held: dict[int, np.ndarray] = {}
        for frame in rows:
            frame = frame[self._new(frame["question_number"].fillna(-1).to_numpy(np.int64), held)]  # came for the first time
            if not len(frame):
                continue
            total += len(frame)
            last = max(last, int(frame["ts"].max().timestamp() * 1000))
            num_ctx = max(num_ctx, int(frame["num_ctx"].fillna(0).max()))
            sent = max(sent, int(frame["approx_tokens"].fillna(0).max()))
            errors += int((frame["status"] == "error").sum())
            good = frame[frame["status"] == "ok"]
            ok += len(good)
            taken = good["runtime_seconds"].dropna()
            seconds, timed = seconds + float(taken.sum()), timed + len(taken)
            for token, n in good["prompt_eval_count"].dropna().astype(int).value_counts().items():
                times[int(token)] = times.get(int(token), 0) + int(n)
        self._write(held)
        for token, n in times.items():
            self.tokens.updateValue((token,), ((self.tokens.getValue((token,))[0] if self.tokens.containsKey((token,)) else 0) + n,))
        self.totals.update((int(total), int(ok), int(errors), seconds, timed, num_ctx, sent, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.silent_ms)
        yield self._row(key, False)

    def _new(self, questions: np.ndarray, held: dict[int, np.ndarray]) -> np.ndarray:
        """Which of the questions come for the first time; they are noted in the entries held."""
        first = np.zeros(len(questions), bool)
        first[np.unique(questions, return_index=True)[1]] = True
        parts, at = np.divmod(questions, SHARED)
        order = np.argsort(parts, kind="stable")
        borders = np.flatnonzero(np.diff(parts[order])) + 1
        for rows in np.split(order, borders) if len(order) else ():
            part = int(parts[rows[0]])
            if part not in held:
                if len(held) >= HELD:
                    self._write(held)
                held[part] = places_of(self.asked.getValue((part,))[0]) if self.asked.containsKey((part,)) else np.zeros(SHARED, bool)
            first[rows] &= ~held[part][at[rows]]
            held[part][at[rows]] = True
        return first

    def _write(self, held: dict[int, np.ndarray]) -> None:
        for part, flags in held.items():
            self.asked.updateValue((part,), (packed_places(flags),))
        held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The model has been silent: its last row, and its state is given up."""
        if self.totals.exists():
            yield self._row(key, True)
            for state in (self.totals, self.tokens, self.asked):
                state.clear()

    def _row(self, key, ended: bool) -> pd.DataFrame:
        total, ok, errors, seconds, timed, num_ctx, sent, _ = self.totals.get()
        context, told = context_status_of({k[0]: v[0] for k, v in self.tokens.iterator()}, sent, num_ctx)
        least, median, most = told or (None, None, None)
        status = "failed" if ended and total < self.expected else run_status_of(ok, errors, total)
        row = (key[0], total, ok, errors, least, None if median is None else int(median), most, seconds if timed else None, seconds / timed if timed else None, context, status, ended)
        return pd.DataFrame([row], columns=[c.split()[0] for c in STATUS_SCHEMA.split(", ")]).astype({"prompt_min": "Int32", "prompt_median": "Int32", "prompt_max": "Int32"})

    def close(self) -> None:
        pass


def run_states(answers: DataFrame, silent: str = "30 minutes", late: str = "10 minutes", expected: int = 0) -> DataFrame:
    """A row of STATUS_SCHEMA for each model and batch that brought answers of it, and a last one (ended) when no answer
    has come for `silent`: of what run_summary says of the same answers, and failed if it gave fewer than `expected`.

    answers: a stream of model_name, question_number, status, prompt_eval_count, runtime_seconds, num_ctx,
    approx_tokens and ts. A question's answer counts once, however often it arrives. State lasts until a model's end:
    some bits or two bytes a question (SHARED neighbouring numbers are one entry) and a row a number of tokens. Needs the RocksDB state store."""
    silent_ms = int(pd.Timedelta(silent).total_seconds() * 1000)
    columns = ["model_name", "question_number", "status", "prompt_eval_count", "runtime_seconds", "num_ctx", "approx_tokens", "ts"]
    timed = answers.select(*columns).withWatermark("ts", late)
    return timed.groupBy("model_name").transformWithStateInPandas(_Run(silent_ms, expected), STATUS_SCHEMA, "update", "eventTime")
