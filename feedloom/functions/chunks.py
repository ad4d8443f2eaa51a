"""Sequential text work that Catalyst can't express, as Arrow-batched pandas UDFs."""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import CUES

TURNS = "array<struct<speaker:string,text:string>>"
#: Rows and bytes in one Arrow batch of whole texts handed to Python.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def short_batches(rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch of the session holds, as texts may be long; smaller bounds that are set stay."""
    conf = SparkSession.active().conf
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}")
        now = int(now.rstrip("bB")) if now.rstrip("bB").lstrip("-").isdigit() else 0
        if not 0 < now <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def cut_sentences(text: str | None, size: int = 2000) -> list[str]:
    """Pieces of at most `size` characters that end after a period in their last 30 %, if there is one."""
    if text is None:
        return []
    out, at = [], 0
    while len(text) > size and at < len(text):
        piece = text[at : at + size]
        stop = piece.rfind(".")
        if size * 0.7 < stop < len(piece) - 1:
            piece = piece[: stop + 1]
        out.append(piece)
        at += len(piece)
    return out or [text]


def cut_speech(text: str | None, size: int = 3800) -> list[str]:
    """Pieces for speech: cut after a separator line, else a blank line, else a sentence, past the middle."""
    if text is None:
        return []
    out, lo, hi = [], 0, len(text)
    while hi - lo > size:
        at = lo + size
        for mark in ("---", "\n\n", ". "):
            found = text.rfind(mark, lo, lo + size + len(mark))
            if found - lo > size * 0.5:
                at = found + len(mark)
                break
        out.append(text[lo:at].strip())
        # What is left is trimmed by its bounds, not copied.
        lo = at
        while lo < hi and text[lo].isspace():
            lo += 1
        while hi > lo and text[hi - 1].isspace():
            hi -= 1
    if hi > lo or not out:
        out.append(text[lo:hi])
    return out


def chunk_sentences(size: int = 2000):
    short_batches()

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_sentences(t, size))

    return run


def chunk_speech(size: int = 3800):
    short_batches()

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_speech(t, size))

    return run


STRUCTURE = (
    (re.compile(r"^##\s*.+$", re.M), ""), (re.compile(r"\[[0-9:]+\]\s*"), ""), (re.compile(r"\(≈?[0-9]+s\)"), ""),
    (re.compile(r"^---+$", re.M), ""), (re.compile(r"^Segment [0-9]+\s*[—–-]\s*.+$", re.M), ""),
)
LABEL = re.compile(r"\*?\*?(HOST|COHOST):?\*?\*?\s*", re.I)


def turns_of(text: str | None) -> list[tuple[str, str]]:
    """(speaker, text) in order, one speaker's parts in a row joined.  A label needs
    no colon, so "host" inside a word is one too; without labels all is HOST's."""
    for pattern in CUES:
        text = re.sub(pattern, "", text or "")
    for pattern, new in STRUCTURE:
        text = pattern.sub(new, text)
    out: list[tuple[str, str]] = []
    speaker, at = "HOST", 0
    marks = [(m.start(), m.end(), m[1].upper()) for m in LABEL.finditer(text)]
    for start, end, label in [*marks, (len(text), len(text), "")]:
        said = re.sub(r"\s{2,}", " ", re.sub(r"\*\*([^*]+)\*\*", r"\1", text[at:start].strip())).strip()
        if said:
            if out and out[-1][0] == speaker:
                out[-1] = (speaker, f"{out[-1][1]} {said}")
            else:
                out.append((speaker, said))
        speaker, at = label or speaker, end
    return out


def speaker_turns():
    short_batches()

    @F.pandas_udf(TURNS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"speaker": s, "text": x} for s, x in turns_of(t)])

    return run
