"""The language model behind a plug: an adapter answers prompts, everything else is plans."""

from __future__ import annotations

import json
import time
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd


class ModelAdapter(Protocol):
    """Answers a batch of papers (dicts of paper_id, title, abstract) with one raw text."""

    def answer(self, papers: list[dict]) -> str: ...


class RuleAdapter:
    """A deterministic stand-in: KEEP if the text holds a keyword, REJECT if it holds a bar, else MAYBE."""

    def __init__(self, keep: tuple[str, ...], reject: tuple[str, ...] = (), break_on: str = "", inclusion: dict[str, str] | None = None, exclusion: dict[str, str] | None = None):
        self.keep, self.reject, self.break_on = keep, reject, break_on
        self.inclusion, self.exclusion = inclusion or {}, exclusion or {}  # criterion id: word that meets it

    def answer(self, papers: list[dict]) -> str:
        if self.break_on and any(self.break_on in p["title"] for p in papers):
            return "not JSON"
        return json.dumps({"items": [self._one(p) for p in papers]})

    def _one(self, paper: dict) -> dict:
        whole = f"{paper['title']} {paper['abstract']}".lower()
        bar = next((w for w in self.reject if w in whole), None)
        hit = next((w for w in self.keep if w in whole), None)
        decision = "REJECT" if bar else "KEEP" if hit else "MAYBE"
        quote = paper["title"] if decision != "MAYBE" else ""
        assessed = [[{"criterion_id": i, "status": "MET" if w in whole else "NOT_MET"} for i, w in criteria.items()] for criteria in (self.inclusion, self.exclusion)]
        return {"paper_id": paper["paper_id"], "decision": decision, "confidence": 0.9 if decision != "MAYBE" else 0.5, "reason": f"rule {bar or hit or 'none'}", "evidence_quote": quote, "inclusion_assessments": assessed[0], "exclusion_assessments": assessed[1], "risk_flags": []}


def answer_with_retry(adapter: ModelAdapter, papers: list[dict], usable: Callable[[str, list[dict]], list[str]]) -> list[tuple[list[str], str]]:
    """Answers that cover all papers: an unusable part is halved down to one paper, which gets one more try.

    ``usable`` names the papers that a raw answer settles. Papers that stay open
    come back with a blank answer and become technical MAYBEs.
    """
    raw = adapter.answer(papers)
    good = set(usable(raw, papers))
    out = [([p["paper_id"] for p in papers if p["paper_id"] in good], raw)] if good else []
    left = [p for p in papers if p["paper_id"] not in good]
    if not left:
        return out
    if len(papers) > 1:
        half = (len(left) + 1) // 2
        for part in (left[:half], left[half:]):
            out += answer_with_retry(adapter, part, usable) if part else []
        return out
    raw = adapter.answer(left)
    return [*out, ([left[0]["paper_id"]], raw if usable(raw, left) else "")]


def settled(raw: str, papers: list[dict]) -> list[str]:
    """Ids that a raw answer covers once, if it is an object with items for known ids only."""
    text = raw.strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        items = json.loads(text)["items"]
        ids = [i["paper_id"] for i in items]
    except (ValueError, KeyError, TypeError):
        return []
    known = {p["paper_id"] for p in papers}
    return [] if set(ids) - known else [i for i in ids if ids.count(i) == 1]


def batches_of(papers: list[dict], size: int, max_chars: int) -> Iterator[list[dict]]:
    """Runs of at most ``size`` papers and ``max_chars`` characters (a longer paper goes alone)."""
    held, chars = [], 0
    for p in papers:
        n = len(p["title"]) + len(p["abstract"])
        if held and (len(held) == size or chars + n > max_chars):
            yield held
            held, chars = [], 0
        held.append(p)
        chars += n
    if held:
        yield held


def screening_udf(adapter: ModelAdapter, size: int = 4, max_chars: int = 14_000, budget_seconds: float = 1_800.0):
    """mapInPandas function: (paper_id, title, abstract) -> (ids, raw), a row per answer; blank raw after the time budget."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = time.monotonic() + budget_seconds
        for pdf in frames:
            papers = pdf.fillna("").to_dict("records")
            rows = []
            for batch in batches_of(papers, size, max_chars):
                if time.monotonic() > end:
                    rows.append(([p["paper_id"] for p in batch], ""))
                    continue
                rows += answer_with_retry(adapter, batch, settled)
            yield pd.DataFrame(rows, columns=["ids", "raw"])

    return run


#: A row of :func:`reading_udf`: the papers that an answer settles, and the answer.
READING = "paper_id array<string>, title array<string>, abstract array<string>, held array<string>, wanted array<boolean>, raw string"
#: Characters of papers that are passed on together.
READ_CHARS = 2_000_000


def reading_udf(adapter: ModelAdapter, size: int = 4, max_chars: int = 14_000, budget_seconds: float = 1_800.0):
    """mapInPandas function: (paper_id, title, abstract, held, wanted, asked) -> READING.

    An answer stays beside the papers that it settles, so no text is joined to it. Papers
    that are not asked about have a null answer, and those after the time budget, which
    counts the time spent on answers, a blank one.
    """
    columns = [field.split()[0] for field in READING.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent = 0.0
        for pdf in frames:
            rows, asked = list(pdf[columns[:-1]].itertuples(index=False, name=None)), pdf["asked"].to_numpy(bool)
            out, chars = [], 0

            def put(answered: list[tuple], raw: str | None) -> int:
                out.append((*map(list, zip(*answered, strict=True)), raw))  # noqa: B023
                return sum(len(r[1]) + len(r[2]) for r in answered)

            papers = [dict(zip(columns[:3], r, strict=False)) for r, a in zip(rows, asked, strict=True) if a]
            waiting = deque(r for r, a in zip(rows, asked, strict=True) if a)
            for row in (r for r, a in zip(rows, asked, strict=True) if not a):
                chars += put([row], None)
                if chars > READ_CHARS:
                    yield pd.DataFrame(out, columns=columns)
                    out, chars = [], 0
            for batch in batches_of(papers, size, max_chars):
                own = defaultdict(deque)  # rows of an id in their order, in which answers come too
                for p in batch:
                    own[p["paper_id"]].append(waiting.popleft())
                began = time.monotonic()
                answers = [([p["paper_id"] for p in batch], "")] if spent > budget_seconds else answer_with_retry(adapter, batch, settled)
                spent += time.monotonic() - began
                for ids, raw in answers:
                    chars += put([own[i].popleft() for i in ids], raw)
                if chars > READ_CHARS:
                    yield pd.DataFrame(out, columns=columns)
                    out, chars = [], 0
            yield pd.DataFrame(out, columns=columns)

    return run
