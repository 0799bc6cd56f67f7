"""Citation handles: short names for documents, minted, expanded in whole texts, and expanded in streams of parts.

A real citation is ``[[kind:id|label]]``, a handle ``[[k:slug]]``. Text is read by
a scanner that splits it into plain runs and bracketed marks; what a mark
becomes is told by the handles of a turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import let

# Kinds and their letters, the longest slug, and what stands for common words of a circular's label.
KINDS = {"circular": "c", "attachment": "a", "law": "l"}
SLUG = 56
SHORT = (("circular letter", "CL"), ("circular", "C"), ("no", " "), ("of", " "))
#: An open bracket with more text after it is no citation that is being written.
HOLD = 200

_LETTERS = {v: k for k, v in KINDS.items()}
_HEX = "0123456789abcdefABCDEF"
_GROUPS = (8, 4, 4, 4, 12)


def slug_words(label: Column, kind: Column) -> Column:
    """The words of a slug: a circular's label shortened, an attachment's without its ending."""
    text = F.trim(F.coalesce(label, F.lit("")))
    brief = text
    for words, sign in SHORT:
        brief = F.regexp_replace(brief, rf"(?i)\b{words.replace(' ', r'\s+')}\b\.?" if words == "no" else rf"(?i)\b{words.replace(' ', r'\s+')}\b", sign)
    text = F.when(kind == "attachment", F.regexp_replace(text, r"\.[A-Za-z0-9]{1,5}$", "")).when(kind == "circular", brief).otherwise(text)
    return F.filter(F.split(F.replace(text, F.lit("&"), F.lit("")), "[^A-Za-z0-9]+"), lambda w: w != "")


def slug(label: Column, kind: Column | None = None) -> Column:
    """A label as a slug; a long one keeps its first words and its last; "doc" without any."""

    def made(words: Column) -> Column:
        last = F.element_at(words, -1)
        # How many first words fit beside the last one.
        joined = lambda i: F.length(F.array_join(F.slice(words, F.lit(1), i), "-"))
        fits = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: (i < F.size(words)) & (joined(i) <= SLUG - F.length(last) - 1)))
        cut = let(fits, lambda n: F.when(n > 0, F.concat(F.array_join(F.slice(words, F.lit(1), n), "-"), F.lit("-"), last)).otherwise(F.left(last, F.lit(SLUG))))
        whole = F.array_join(words, "-")
        return F.when(F.size(words) == 0, F.lit("doc")).when(F.length(whole) <= SLUG, whole).otherwise(cut)

    return let(slug_words(label, F.lit("circular") if kind is None else kind), made)


def minted(documents: DataFrame, turn: str, kind: str = "kind", label: str = "label", order: str = "position") -> DataFrame:
    """``documents`` with the slug that each gets within its turn: equal ones, case aside, get -2, -3 and so on in order.

    A numbered slug may itself be another's; the operator numbers within equal
    slugs, so such a clash shows as two rows of one slug, which ``clashes`` finds.
    """
    made = documents.withColumn("slug", slug(F.col(label), F.col(kind)))
    nth = F.row_number().over(Window.partitionBy(turn, F.lower("slug")).orderBy(order))
    return made.withColumn("_nth", nth).withColumn("slug", F.concat("slug", F.when(F.col("_nth") > 1, F.concat(F.lit("-"), F.col("_nth").cast("string"))).otherwise(""))).drop("_nth")


def python_slug(label: str, kind: str = "circular") -> str:
    """``slug`` for one label, as handles of a running turn need it."""
    text = (label or "").strip()
    if kind == "attachment":
        text = re.sub(r"\.[A-Za-z0-9]{1,5}$", "", text)
    elif kind == "circular":
        for words, sign in SHORT:
            text = re.sub(rf"(?i)\b{words.replace(' ', r'\s+')}\b" + (r"\.?" if words == "no" else ""), sign, text)
    words = re.findall("[A-Za-z0-9]+", text.replace("&", ""))
    if not words:
        return "doc"
    whole = "-".join(words)
    if len(whole) <= SLUG:
        return whole
    room, kept = SLUG - len(words[-1]) - 1, 0
    while kept < len(words) - 1 and len("-".join(words[: kept + 1])) <= room:
        kept += 1
    return "-".join([*words[:kept], words[-1]]) if kept else words[-1][:SLUG]


def runs(text: str) -> Iterator[tuple[str, str]]:
    """("plain" or "mark", part): the text in order, cut at brackets that close on their line."""
    at = 0
    while True:
        start = text.find("[[", at)
        if start < 0:
            break
        end = text.find("]]", start + 2)
        line = text.find("\n", start)
        if end < 0 or (0 <= line < end):
            break_at = len(text) if end < 0 and line < 0 else start + 2
            if break_at == len(text):
                break
            yield "plain", text[at:break_at]
            at = break_at
            continue
        inner = text.rfind("[[", start, end)
        if inner > at:
            yield "plain", text[at:inner]
        yield "mark", text[inner : end + 2]
        at = end + 2
    if at < len(text):
        yield "plain", text[at:]


def bare_ids(text: str) -> Iterator[tuple[int, int]]:
    """Where ids of 8-4-4-4-12 hexadecimal digits stand as words of their own."""
    at = 0
    while (dash := text.find("-", at)) >= 0:
        start, at = dash - _GROUPS[0], dash + 1
        if start < 0 or (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
            continue
        place, good = start, True
        for i, width in enumerate(_GROUPS):
            part = text[place : place + width]
            good = good and len(part) == width and all(c in _HEX for c in part) and (i == 4 or text[place + width : place + width + 1] == "-")
            place += width + (i < 4)
        after = text[place : place + 1]
        if good and not (after.isalnum() or after == "_"):
            yield start, place
            at = place


def without_bare_ids(text: str) -> str:
    """The text without ids, their brackets and the blanks before them."""
    out, at = [], 0
    for start, end in bare_ids(text):
        before, after = text[at:start].rstrip(), text[end:].lstrip()
        if before and after and before[-1] + after[0] in ("()", "[]"):
            before, end = before[:-1], len(text) - len(after) + 1
            out.append(before.rstrip(" \t"))
        else:
            out.append(text[at:start].rstrip(" \t"))
        at = end
    return "".join([*out, text[at:]])


class Handles:
    """The handles of one turn: minted on first sight, expanded later."""

    def __init__(self) -> None:
        self.slugs: dict[tuple[str, str], str] = {}
        self.known: dict[str, tuple[str, str, str]] = {}
        self.dropped: list[tuple[str, str]] = []
        self.told = 0

    def mint(self, kind: str, key: str, label: str) -> str:
        if (kind, key) not in self.slugs:
            base = name = python_slug(label, kind)
            n = 1
            while name.lower() in self.known:
                n += 1
                name = f"{base}-{n}"
            self.slugs[kind, key], self.known[name.lower()] = name, (kind, key, label)
        return f"[[{KINDS[kind]}:{self.slugs[kind, key]}]]"

    def fresh_drops(self) -> list[tuple[str, str]]:
        """What was dropped since the last call."""
        found, self.told = self.dropped[self.told :], len(self.dropped)
        return found

    @staticmethod
    def parts(mark: str) -> tuple[str, str, str | None] | None:
        """(kind or letter, id or slug, label) of a mark; None if it is no citation."""
        head, _, label = mark[2:-2].partition("|")
        kind, colon, key = head.partition(":")
        if not colon or "]" in key or "]" in label:
            return None
        if kind in KINDS:
            return kind, key.strip(), label
        if kind.strip().lower() in _LETTERS:
            return kind.strip().lower(), key.strip(), label
        return None

    def replayed(self, text: str | None) -> str:
        """A stored answer for the model: citations as handles, no ids."""
        out = []
        for what, part in runs(text or ""):
            found = self.parts(part) if what == "mark" else None
            out.append(self.mint(found[0], found[1], (found[2] or "").strip()) if found and found[0] in KINDS else part)
        return without_bare_ids("".join(out))

    def expand(self, text: str | None) -> str:
        """Handles as citations; unknown ones become plain words, unknown citations their labels, and bare ids go."""
        out: list[str] = []
        close = False
        for what, part in runs(text or ""):
            found = self.parts(part) if what == "mark" else None
            if found is None:
                # What is left of brackets around a citation that went closes with it.
                if close and out and out[-1][-1:] + part[:1] in ("()", "[]"):
                    out[-1], part = out[-1][:-1].rstrip(" \t"), part[1:]
                out.append(without_bare_ids(part) if what == "plain" else part)
                close = False
                continue
            kind, key, label = found
            if kind in KINDS:
                if (kind, key) in self.slugs:
                    said = f"[[{kind}:{key}|{label or ''}]]"
                else:
                    said = (label or "").strip()
                    self.dropped.append(("unknown id", f"{kind}:{key}"))
            elif key.lower() in self.known:
                said = "[[{}:{}|{}]]".format(*self.known[key.lower()])
            else:
                said = key
                self.dropped.append(("unknown handle", f"{kind}:{key}"))
            close = not said
            if close and out:
                out[-1] = out[-1].rstrip(" \t")
            elif said:
                out.append(said)
        return "".join(out)


class StreamExpander:
    """Expands parts as they come.

    A scanner tells how the text so far may go on: in an open bracket, in an id
    or a word that may become one, or in blanks that a dropped citation would
    take along. From there on text is held, with the blanks before it; more than
    ``HOLD`` characters are let go.
    """

    def __init__(self, handles: Handles, held: str = ""):
        self.handles, self.held = handles, held

    @staticmethod
    def settled(text: str) -> int:
        """How many characters can't change any more."""
        start, end = text.rfind("[["), len(text)
        states = [end]
        if start >= 0 and (text.find("]]", start) < 0 or text.endswith("]]")):
            states.append(start)
        elif text[-1:] in ("[", "("):
            states.append(end - 1)
        # Back over hexadecimal groups, each no longer than an id's.
        at = end
        while at and (text[at - 1] in _HEX or text[at - 1] == "-"):
            at -= 1
        groups = text[at:].split("-")
        whole = not at or not (text[at - 1].isalnum() or text[at - 1] == "_")
        if at < end and whole and groups[0] and len(groups) <= len(_GROUPS) + (groups[-1] == "") and len(groups[0]) <= _GROUPS[0] and all(len(g) <= _GROUPS[4] for g in groups) and all(groups[:-1]):
            states.append(at)
        at = min(states)
        # A bracket around what may go is held with it, and blanks before both.
        at -= bool(at and at < end and text[at - 1] in "([")
        while at and text[at - 1].isspace():
            at -= 1
        at -= bool(at and at < end and text[at - 1] in "([")
        while at and text[at - 1].isspace():
            at -= 1
        return end if end - at > HOLD else at

    def feed(self, part: str) -> str:
        text = self.held + part
        at = self.settled(text)
        self.held = text[at:]
        return self.handles.expand(text[:at])

    def close(self) -> str:
        rest, self.held = self.held, ""
        return self.handles.expand(rest)
