"""What comes from outside — embedders, judges, extractors — as functions that are handed in.

Each has a deterministic stand-in, so that plans and tests need no model.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hash_embedder(texts: list[str], width: int = 64) -> np.ndarray:
    """Signed word counts hashed to ``width`` places, at length one; zero for no words."""
    out = np.zeros((len(texts), width), np.float32)
    for row, text in enumerate(texts):
        for word in re.findall(r"\w+", (text or "").lower()):
            h = zlib.crc32(word.encode())
            out[row, h % width] += 1 if h & (1 << 20) else -1
    return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-9)


def embed(frame: DataFrame, embedder: Embedder = hash_embedder, text: str = "text", output: str = "embedding") -> DataFrame:
    """``frame`` with a vector of each text, in batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embedder(batch.fillna("").tolist())))

    return frame.withColumn(output, run(text))


Judge = Callable[[str, list[dict]], list[dict]]


def keyword_judge(question: str, items: list[dict]) -> list[dict]:
    """Says yes to texts that hold every word of the question."""
    words = question.lower().split()
    return [{"id": x["id"], "discusses": all(w in (x["text"] or "").lower() for w in words), "reason": "words"} for x in items]


def adjudicate(candidates: DataFrame, question: str, judge: Judge = keyword_judge, size: int = 12) -> DataFrame:
    """(id, verdict, reason): candidates judged ``size`` at a time; a batch that fails is undetermined, not lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), size):
                items = pdf.iloc[at : at + size][["id", "text"]].to_dict("records")
                try:
                    said = {v["id"]: v for v in judge(question, items)}
                except Exception as error:  # a provider's failure is a result here
                    said = {x["id"]: {"reason": type(error).__name__} for x in items}
                for x in items:
                    v = said.get(x["id"], {"reason": "no answer"})
                    yes = v.get("discusses")
                    out.append((x["id"], "undetermined" if yes is None else "included" if yes else "excluded", v.get("reason")))
            yield pd.DataFrame(out, columns=["id", "verdict", "reason"])

    return candidates.select("id", "text").mapInPandas(run, "id long, verdict string, reason string")


def lenient_object(text: str | None) -> dict | None:
    """The first JSON object in a text: bare, fenced, quoted twice, or a list as ``items``."""
    if not text:
        return None
    decoder = json.JSONDecoder()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for body in ([fenced[1]] if fenced else []) + [text]:
        for m in re.finditer(r"[\[{\"]", body):
            try:
                found = decoder.raw_decode(body[m.start() :])[0]
            except ValueError:
                continue
            if isinstance(found, str):
                found = lenient_object(found) if found != text else None
            if isinstance(found, list):
                return {"items": found}
            if isinstance(found, dict):
                return found
    return None


def markdown_table(rows: list[list[str | None]] | None) -> str:
    """A table's rows in Markdown, short rows filled up, bars escaped."""
    clean = [[" ".join((c or "").split()).replace("|", "\\|") for c in r] for r in rows or [] if any(c for c in r)]
    if not clean:
        return ""
    width = max(map(len, clean))
    clean = [r + [""] * (width - len(r)) for r in clean]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(clean[0]), line(["---"] * width), *map(line, clean[1:])])


def verify_span(span: str | None, passage: str, limit: int = 600) -> str | None:
    """The span cut to ``limit`` if it stands in the passage, blanks and quotes at its ends aside; else None."""
    plain = " ".join((span or "").split()).strip("\"'“”‘’ ….")
    return plain[:limit] if plain and plain in " ".join(passage.split()) else None
