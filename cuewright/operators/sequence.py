"""Ordered operators within a key: islands, fills, context windows, and folds.

A fold's output depends on rows it changed itself, which no window function can express; folds run per key on that key's
rows in order, in one task, as their definition asks. Keys are read one after the other from sorted Arrow batches, so many
small keys cost no more than their rows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scoring import blocks


def ordered(keys: Sequence[str], by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*by)


def islands(df: DataFrame, keys: Sequence[str], by: Sequence[str], opens: Callable[[WindowSpec], Column], name: str = "run") -> DataFrame:
    """df with a run number that grows where ``opens`` holds (null counts as true: the first row opens)."""
    w = ordered(keys, by)
    marked = df.withColumn(name, F.coalesce(opens(w), F.lit(True)).cast("int"))
    return marked.withColumn(name, F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def fill(c: Column, w: WindowSpec) -> Column:
    """Forward fill, then the head from the first known value."""
    return F.coalesce(F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(c, True).over(w.rowsBetween(0, Window.unboundedFollowing)))


#: A fold turns up to so many bytes of Arrow into dictionaries at a time, or one row, and hands on about so many rows.
_BYTES, _ROWS = 1 << 20, 10_000


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``_BYTES``; rows that hold whole lists are many times larger as objects."""
    n = max(1, batch.num_rows * _BYTES // max(1, batch.nbytes))
    for i in range(0, batch.num_rows, n):
        yield batch.slice(i, n)


def fold(df: DataFrame, keys: Sequence[str], by: Sequence[str], step: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """Runs step over each key's rows, sorted, as dictionaries; what step gives needs only the columns of the schema."""
    out = T.StructType.fromDDL(schema)
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, open_, key, done = to_arrow_schema(out), [], None, []

        def close() -> None:
            done.extend({n: r[n] for n in target.names} for r in step(open_))

        for part in (p for b in batches for p in _parts(b)):
            for k, rows in groupby(part.to_pylist(), lambda r: tuple(r[c] for c in keys)):
                if open_ and k != key:
                    close()
                    open_ = []
                    if len(done) >= _ROWS:
                        yield pa.RecordBatch.from_pylist(done, schema=target)
                        done.clear()
                open_ += rows
                key = k
        if open_:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=target)

    return df.repartition(*keys).sortWithinPartitions(*keys, *by).mapInArrow(run, out)


# Steps of the folds; each takes one file's rows in order.


def normal_timing(rows: list[dict], least: float = 0.9, lead: float = 0.12, tail: float = 0.25, apart: float = 0.05) -> Iterable[dict]:
    """Lead-in, tail and a least duration; a cue keeps clear of its predecessor as moved and of its successor as it was."""
    limits = [r["s"] - apart for r in rows[1:]] + [float("inf")]
    behind = apart
    for r, limit in zip(rows, limits, strict=True):
        start, stop = max(behind, r["s"] - lead), min(limit, r["e"] + tail)
        stop = stop if stop - start >= least else min(limit, start + least)
        stop = stop if stop > start else start + 0.5
        behind = stop + apart
        yield r | {"s": start, "e": stop}


def _columns(rows: list[dict], *names: str) -> list[np.ndarray]:
    return [np.array([r[n] for r in rows], float) for n in names]


def _first(mask: np.ndarray, default: int) -> int:
    at = int(mask.argmax()) if len(mask) else 0
    return at if len(mask) and mask[at] else default


def _main_voice(rows: list[dict], length: np.ndarray) -> str:
    """The voice with most seconds; the first of equals."""
    voices = [r["speaker"] for r in rows]
    return max(dict.fromkeys(voices), key=lambda v: sum(d for d, x in zip(length, voices, strict=True) if x == v))


def speech_windows(rows: list[dict], speech: float = 10.0, audio: float = 30.0, by_speaker: bool = False, voice_least: float = 0.0) -> list[dict]:
    """Windows of consecutive spans: each ends where it holds ``speech`` seconds of speech, where the next span would stretch it
    beyond ``audio`` seconds, or, by speaker, where the voice changes once it holds ``voice_least`` seconds; a small rest joins the last.

    From each opening the next one is looked up: in the prefix sums of speech, the ends, and the list of voice changes."""
    s, e = _columns(rows, "s", "e")
    length, n = e - s, len(rows)
    until = np.append(0.0, np.cumsum(length))
    changes = [j for j in range(1, n) if rows[j]["speaker"] != rows[j - 1]["speaker"]] if by_speaker else []
    opens = [0]
    while opens[-1] < n:
        i = opens[-1]
        full = max(i + 1, int(np.searchsorted(until, until[i] + speech - 1e-9)))
        long = i + 1 + _first(e[i + 1 : full] - s[i] > audio, n)
        enough = max(i + 1, int(np.searchsorted(until, until[i] + voice_least - 1e-9)))
        turn = bisect_left(changes, enough)
        opens.append(min(full, long, changes[turn] if turn < len(changes) else n, n))
    out = []
    for i, j in zip(opens[:-1], opens[1:], strict=True):
        voice = _main_voice(rows[i:j], length[i:j]) if by_speaker else ""
        out.append({"file_id": rows[i]["file_id"], "window": len(out), "s": s[i], "e": e[j - 1], "speech": float(length[i:j].sum()), "spans": j - i, "speaker": voice})
    if len(out) > 1 and out[-1]["speech"] < speech / 3 and out[-1]["speaker"] == out[-2]["speaker"]:
        rest = out.pop()
        out[-1] |= {"e": rest["e"], "speech": out[-1]["speech"] + rest["speech"], "spans": out[-1]["spans"] + rest["spans"]}
    return out


def speech_chunks(rows: list[dict], longest: float = 30.0, silence: float = 2.0, shortest: float = 6.0, gap: float = 30.0, pad: float = 0.25, total: float | None = None) -> Iterable[dict]:
    """Recogniser chunks: closed by a change of language, a silence once long enough, or their length; padded, apart, and within
    ``total`` seconds (by default the column ``total`` of the rows, if there is one)."""
    s, e, lang = [], [], []
    for r in rows:  # spans over the greatest length are cut to it
        starts = np.arange(r["s"], r["e"], longest) if r["e"] - r["s"] > longest else np.array([r["s"]])
        s += starts.tolist()
        e += np.minimum(r["e"], starts + longest).tolist() if len(starts) > 1 else [r["e"]]
        lang += [r["lang"]] * len(starts)
    s, e, known = np.array(s), np.array(e), np.array([x or "" for x in lang])
    pause = s[1:] - e[:-1]
    opens = [0]
    while opens[-1] < len(s):
        i = opens[-1]
        other = (known[i + 1 :] != known[i]) & (known[i + 1 :] != "") & (known[i] != "")
        quiet = (pause[i:] >= silence) & ((e[i:-1] - s[i] >= shortest) | (pause[i:] >= gap))
        opens.append(i + 1 + _first(other | (e[i + 1 :] - s[i] > longest) | quiet, len(s) - i - 1))
    first, last = np.array(opens[:-1]), np.array(opens[1:]) - 1
    limit = total if total is not None else rows[0].get("total")
    stop = np.minimum(e[last] + pad, np.inf if limit is None else limit)
    start = np.maximum(np.maximum(0.0, s[first] - pad), np.append(0.0, stop[:-1]))
    for k, i in enumerate(first):
        yield {"file_id": rows[0]["file_id"], "chunk": k, "s": float(start[k]), "e": float(stop[k]), "lang": lang[i]}


def cover_chunks(level: np.ndarray, spans: list[dict], total: float, frame: float = 0.1, longest: float = 30.0, quiet_db: float = 6.0, quiet_sec: float = 2.5, pad: float = 0.25, dominant: str | None = None) -> list[dict]:
    """Chunks over the whole time line but for long quiet stretches. level: RMS of each frame; spans: s, e, lang, in order.

    Frames within ``quiet_db`` of the noise floor (the 5th percentile) are quiet; runs of ``quiet_sec`` and more, and any at the
    start, are left out. Chunks are cut where the spans' language changes, and those over ``longest`` at the last pause between
    spans in their last 40 %, else at the quietest frame there. A chunk's language is the one with most seconds in it."""
    if not len(level):
        return []
    quiet = level < np.percentile(level, 5) * 10 ** (quiet_db / 20)
    edges = np.flatnonzero(np.diff(quiet)) + 1
    runs = np.split(np.arange(len(level)), edges)
    heard = np.concatenate([np.full(len(r), not quiet[r[0]] or (k > 0 and len(r) < round(quiet_sec / frame))) for k, r in enumerate(runs)])
    bounds = np.flatnonzero(np.diff(np.concatenate([[False], heard, [False]]).astype(int)))
    pauses = [(a["e"] + b["s"]) / 2 for a, b in zip(spans[:-1], spans[1:], strict=True) if b["s"] - a["e"] >= 0.3]
    turns = sorted((a["e"] + b["s"]) / 2 for a, b in zip(spans[:-1], spans[1:], strict=True) if a["lang"] and b["lang"] and a["lang"] != b["lang"])

    def cut(a: float) -> float:
        lo, hi = a + 0.6 * longest, a + longest
        fitting = [x for x in pauses if lo <= x <= hi]
        if fitting:
            return max(fitting)
        f, z = int(round(lo / frame, 6)), min(len(level), int(round(hi / frame, 6)))
        return (f + int(level[f:z].argmin())) * frame if z > f else hi

    pieces = []
    for a, z in (bounds.reshape(-1, 2) * frame).tolist():
        if z - a < 0.5:
            continue
        marks = []
        for x in turns:
            if (marks[-1] if marks else a) + 0.3 < x < z - 0.3:
                marks.append(x)
        for lo, hi in zip([a, *marks], [*marks, z], strict=True):
            while hi - lo > longest:
                pieces.append((lo, cut(lo)))
                lo = pieces[-1][1]
            pieces.append((lo, hi))
    out: list[dict] = []
    for lo, hi in pieces:
        start, stop = max(0.0, lo - pad, out[-1]["e"] if out else 0.0), min(total, hi + pad)
        if stop > start:
            seconds: dict[str, float] = {}
            for x in spans:
                if x["lang"] and x["e"] > start and x["s"] < stop:
                    seconds[x["lang"]] = seconds.get(x["lang"], 0.0) + min(x["e"], stop) - max(x["s"], start)
            out.append({"chunk": len(out), "s": start, "e": stop, "lang": max(seconds, key=seconds.__getitem__) if seconds else dominant})
    return out


def pushed_starts(rows: list[dict], gap: float = 0.083, least: float = 1.0) -> Iterable[dict]:
    """Starts pushed behind the previous end, as pushed, plus the gap."""
    free = float("-inf")
    for r in rows:
        start = max(r["s"], free)
        stop = r["e"] if r["e"] > start or start == r["s"] else start + least
        free = stop + gap
        yield r | {"s": start, "e": stop}


def text_chunks(rows: list[dict], size: int = 6000) -> Iterable[dict]:
    """Lines gathered until a chunk holds ``size`` characters, the crossing line included."""
    until = np.cumsum([len(r["text"]) + 1 for r in rows])
    at, before, k = 0, 0, 0
    while at < len(rows):
        stop = min(len(rows), int(np.searchsorted(until, before + size)) + 1)
        yield {"file_id": rows[0]["file_id"], "chunk": k, "lines": stop - at, "chars": int(until[stop - 1]) - before}
        at, before, k = stop, int(until[stop - 1]), k + 1


# Marks that end sentences and clauses, marks that are no words, and scripts without word spaces.
SENTENCE, CLAUSE, MARKS = "。！？!?…", "、,，", " \t\n。、！？!?…,，."
NO_SPACE = ("ja", "zh", "yue", "th")


def _with_marks(rows: list[dict]) -> list[dict]:
    """The words, less empty ones; marks join the word before them, and its time unless that ended its sentence."""
    out: list[dict] = []
    for r in rows:
        token = r["text"].strip()
        if token.strip(MARKS):
            out.append(r | {"length": len(r["text"])})
        elif token and out:
            last, ended = out[-1], out[-1]["text"][-1] in SENTENCE
            out[-1] = last | {"text": last["text"] + token, "e": last["e"] if ended else max(last["e"], r["e"]), "length": last["length"] + len(token)}
    return out


def words_to_cues(rows: list[dict], longest: float = 6.0, chars: int = 34, pause: float = 0.6) -> Iterable[dict]:
    """Cues from timed words: closed by language, pause, length, speaker or sentence end; overflow splits at the last clause
    mark that leaves four characters; stray punctuation joins what stands before.

    Breaks that two neighbours decide come first; each stretch between them is then cut by length, from opening to opening."""
    words = _with_marks(rows)
    if not words:
        return
    s, e, size = _columns(words, "s", "e", "length")
    until = np.append(0.0, np.cumsum(size))
    hard = [0]
    for j, (a, b) in enumerate(zip(words[:-1], words[1:], strict=True), 1):
        if a["lang"] != b["lang"] or b["s"] - a["e"] >= pause or a["speaker"] and b["speaker"] and a["speaker"] != b["speaker"] or a["text"][-1] in SENTENCE:
            hard.append(j)
    clauses = [k for k, w in enumerate(words) if w["text"][-1] in CLAUSE]
    opens = []
    for i, end in zip(hard, [*hard[1:], len(words)], strict=True):
        limit = chars if words[i]["lang"] in NO_SPACE else 2 * chars
        j = i + 1
        opens.append(i)
        while j < end:
            if e[j] - s[i] > longest:
                i = j
                opens.append(i)
            elif until[j + 1] - until[i] > limit:
                ahead = [k for k in clauses[bisect_left(clauses, i + 3) : bisect_right(clauses, j - 2)] if until[j] - until[k + 1] >= 4]
                i = ahead[-1] + 1 if ahead else j
                opens.append(i)
            j += 1
    for k, (i, j) in enumerate(zip(opens, [*opens[1:], len(words)], strict=True)):
        part = words[i:j]
        text = " ".join(("" if part[0]["lang"] in NO_SPACE else " ").join(w["text"] for w in part).split())
        heard = [w for w in part if w["speaker"]]
        voice = _main_voice(heard, np.array([max(0.0, w["e"] - w["s"]) + 0.05 for w in heard])) if heard else ""
        yield {"file_id": part[0]["file_id"], "idx": k, "s": part[0]["s"], "e": part[-1]["e"], "text": text, "lang": part[0]["lang"], "speaker": voice}


def cut_at_turns(rows: list[dict], least: float = 0.4) -> Iterable[dict]:
    """Spans cut at the edges in ``edges`` that lie at least ``least`` from both ends; a piece is as long at least."""
    for r in rows:
        marks = [r["s"]]
        for x in r["edges"] if r["edges"] is not None else []:
            if r["s"] + least < x < r["e"] - least and x - marks[-1] >= least:
                marks.append(x)
        for k, (a, b) in enumerate(zip(marks, [*marks[1:], r["e"]], strict=True)):
            yield {"file_id": r["file_id"], "pos": r["pos"], "piece": k, "s": a, "e": b}


def spread_runs(rows: list[dict], shortest: float = 0.02, longest: float = 3.0, fastest: float = 0.04, usual: float = 0.2, start: float | None = None, end: float | None = None) -> list[dict]:
    """Words of one chunk with runs of broken times re-spread by characters.

    A word is broken if its length is implausible, if it starts before the last good word, or if the next one has its very times.
    A run lasts until three plausible words in a row before which it has room at ``fastest`` seconds a character, else to the
    chunk's end; it is laid behind the last good word at up to ``usual`` seconds a character. start, end: the chunk's bounds (by
    default the columns lo and hi of the rows, else the first start and the last end)."""
    n = len(rows)
    s, e = _columns(rows, "s", "e")
    start = rows[0].get("lo", s[0]) if start is None else start
    end = rows[0].get("hi", e[-1]) if end is None else end
    size = np.array([max(1, len(r["text"])) for r in rows])
    until = np.append(0, np.cumsum(size))
    sound = (e - s >= shortest) & (e - s <= longest)
    twin = np.append((np.abs(np.diff(s)) < 0.001) & (np.abs(np.diff(e)) < 0.001), False)
    on = np.append(sound[1:] & (np.diff(s) >= -0.001), [True, True])  # the word after it goes on plausibly
    going = on[:n] & on[1 : n + 1]
    ns, ne, done = s.copy(), e.copy(), np.zeros(n, bool)
    i, good = 0, -1
    while i < n:
        behind = float("-inf") if good < 0 else ns[good] - 0.001
        if sound[i] and s[i] >= behind and not twin[i]:
            good = i
            i += 1
            continue
        left = ne[good] if good >= 0 else start
        fits = sound[i + 1 :] & (s[i + 1 :] >= behind) & going[i + 1 :] & ~twin[i + 1 :] & (s[i + 1 :] - left >= fastest * (until[i + 1 : n] - until[i]))
        j = i + 1 + _first(fits, n - i - 1)
        right = s[j] if j < n else end
        right = right if right > left else end if end > left else left + 0.5
        width = min(right - left, usual * (until[j] - until[i]))
        at = left + width * (until[i : j + 1] - until[i]) / (until[j] - until[i])
        ns[i:j], ne[i:j] = np.round(at[:-1], 3), np.round(np.minimum(at[1:], right), 3)
        done[i:j] = True
        good, i = j - 1, j
    return [r | {"s": float(a), "e": float(b), "moved": bool(d)} for r, a, b, d in zip(rows, ns, ne, done, strict=True)]


def _characters(words: list[dict]) -> tuple[np.ndarray, str]:
    """Start and end of each character of the words, and the characters."""
    own = ["".join(w["text"].split()) for w in words]
    n = np.array([len(x) for x in own], int)
    if not n.sum():
        return np.empty((0, 2)), ""
    s, e = _columns(words, "s", "e")
    step, k = np.repeat((e - s) / np.maximum(1, n), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    s = np.repeat(s, n)
    return np.stack([s + k * step, s + (k + 1) * step], axis=1), "".join(own)


def transfer_timing(merged: str, primary: list[dict], secondary: list[dict], start: float, end: float, lang: str, slack: float = 0.3) -> list[dict]:
    """Timed words (text, s, e) of a merged text: characters that align with the first timeline take its times, others that align
    with the second its, times that go back or leave the chunk by more than ``slack`` are dropped, and the rest are interpolated."""
    own = "".join(merged.split())
    if not own:
        return []
    times = np.full((len(own), 2), np.nan)
    for told, heard in (_characters(primary), _characters(secondary)):
        for a, b, n in blocks(own, heard):
            free = np.isnan(times[a : a + n, 0])
            times[a : a + n][free] = told[b : b + n][free]
    known, reached, wrong = np.flatnonzero(~np.isnan(times[:, 0])), start, []
    for k, x in zip(known.tolist(), times[known, 0].tolist(), strict=True):
        if reached - slack <= x <= end + slack:
            reached = max(reached, x)
        else:
            wrong.append(k)
    times[wrong] = np.nan
    blank = np.isnan(times[:, 0])
    runs = np.flatnonzero(np.diff(np.concatenate([[False], blank, [False]]).astype(int))).reshape(-1, 2)
    for a, z in runs.tolist():
        left = times[a - 1, 1] if a else start
        right = times[z, 0] if z < len(own) else end
        right = right if right > left else left + 0.1 * (z - a)
        marks = left + (right - left) * np.arange(z - a + 1) / (z - a)
        times[a:z] = np.stack([marks[:-1], marks[1:]], axis=1)
    tokens = list(own) if lang in NO_SPACE else merged.split()
    until = np.append(0, np.cumsum([len("".join(t.split())) for t in tokens]))
    s, e = times[until[:-1], 0], times[until[1:] - 1, 1]
    return [{"text": t, "s": round(a, 3), "e": round(max(b, a + 0.01), 3)} for t, a, b in zip(tokens, s.tolist(), e.tolist(), strict=True)]


def best_splits(rows: list[dict]) -> Iterable[dict]:
    """Where the language changes between neighbouring windows: the split with the greatest sum of the first language's
    evidence (pa) before it and the second's (pb) from it on; the first of equals."""
    a, b = _columns(rows, "pa", "pb")
    sums = np.append(0.0, np.cumsum(a)) + b.sum() - np.append(0.0, np.cumsum(b))
    k = _first(sums >= sums.max() - 1e-9, 0)
    yield {"file_id": rows[0]["file_id"], "split": k, "score": float(sums[k])}
