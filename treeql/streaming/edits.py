"""Edits applied as they arrive: results are the texts that have changed; trees of them come from `parse` or `update_nodes`."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EDITED = "doc_id bigint, version bigint, n_edits int, n_late int, text string"
#: The last so many edits of a document are kept in its state, so that a late one can still take its place among them.
KEPT_EDITS = 1000
_STATE = "base binary, base_version bigint, edits string"


def apply_all(text: bytes, edits: Iterable[tuple[int, int, int, str]]) -> bytes:
    """`text` with edits (version, start_byte, old_end_byte, new_text) applied in order; places beyond its end mean its end."""
    raw = bytearray(text)
    for _, start, end, new in edits:
        start = min(start, len(raw))
        raw[start : max(start, min(end, len(raw)))] = (new or "").encode()
    return bytes(raw)


def _rows(frame: pd.DataFrame) -> dict[int, tuple]:
    """Edits by version; a version that is repeated counts once."""
    columns = (frame[c].tolist() for c in ("version", "start_byte", "old_end_byte", "new_text"))
    return {int(v): (int(v), int(s), int(e), n) for v, s, e, n in reversed(list(zip(*columns)))}


def edited_texts(edits: DataFrame, kept_edits: int = KEPT_EDITS, idle_ms: int | None = None) -> DataFrame:
    """A stream of edits (doc_id, version, start_byte, old_end_byte, new_text) as a stream of texts (doc_id, version, n_edits, n_late, text).

    Edits count in the order of their versions, each version once, however they arrive: a late edit takes its place among the last `kept_edits` of its document, and the edits behind
    it are applied anew. An edit that comes later than these can't be placed; it changes nothing and is counted in `n_late` of a row of its own or of the next one. So the last
    text of a document is that of `final_texts` over the same edits, unless a row says otherwise. A first edit of an empty text gives the whole source.

    State per document: its text before the kept edits, and these. With `idle_ms` the state of a document goes after so much processing time without edits; further edits of
    it then start from an empty text.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        base, base_version, log = state.get if state.exists else (b"", -(1 << 62), "[]")
        held = {x[0]: tuple(x) for x in json.loads(log)}
        came: dict[int, tuple] = {}
        for frame in frames:
            came = _rows(frame) | came
        late = sum(v <= base_version for v in came)
        new = {v: x for v, x in came.items() if v > base_version and v not in held}
        ordered = [x for _, x in sorted((held | new).items())]
        gone, kept = ordered[: max(0, len(ordered) - kept_edits)], ordered[max(0, len(ordered) - kept_edits) :]
        if gone:
            base, base_version = apply_all(base, gone), gone[-1][0]
        state.update((base, base_version, json.dumps(kept)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if new or late:
            yield pd.DataFrame({"doc_id": [key[0]], "version": [ordered[-1][0] if ordered else base_version], "n_edits": [len(new)], "n_late": [late], "text": [apply_all(base, kept).decode("utf-8", "replace")]})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return edits.groupBy("doc_id").applyInPandasWithState(fold, EDITED, _STATE, "append", timeout)


def final_texts(edits: DataFrame) -> DataFrame:
    """The same from a finite table: each document's text after all its edits."""

    def last(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [x for _, x in sorted(_rows(frame).items())]
        return pd.DataFrame({"doc_id": [key[0]], "version": [rows[-1][0]], "n_edits": [len(rows)], "n_late": [0], "text": [apply_all(b"", rows).decode("utf-8", "replace")]})

    return edits.groupBy("doc_id").applyInPandas(last, EDITED)
