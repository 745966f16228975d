"""Reading what models answer: JSON in fences, inside other JSON, with text around it or cut off in the middle.

A list is looked for under its name. If the whole answer isn't valid JSON, the list's items are
read one after another, and what can't be read is told as refused. Items are checked one by one.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from phrasewright.functions.text import col

#: The confidence of an entity that tells none; a longer suggestion of a decision is dropped.
CONFIDENCE, SUGGESTED = 0.75, 200
_FENCE = re.compile(r"```[A-Za-z0-9]*[ \t]*\r?\n(.*?)(?:\r?\n[ \t]*```|\Z)", re.S)
_READER = json.JSONDecoder()
_REFUSED = "refused:array<struct<pos:int,reason:string>>"
ENTITIES = f"struct<items:array<struct<pos:int,text:string,entity_type:string,suggested:string,confidence:double>>,{_REFUSED}>"
DECISIONS = f"struct<items:array<struct<pos:int,text:string,keep:boolean,confidence:double,entity_type:string,suggested:string>>,{_REFUSED}>"


def _inside(value, name: str, deep: int = 8):
    """The list of this name in a value, in what it holds, or in JSON that one of its strings holds."""
    if deep and isinstance(value, dict):
        if isinstance(value.get(name), list):
            return value[name]
        value = list(value.values())
    if deep and isinstance(value, list):
        return next((found for x in value if (found := _inside(x, name, deep - 1)) is not None), None)
    if deep and isinstance(value, str) and f'"{name}"' in value:
        found, _ = read_list(value, name, deep - 1)
        return found or None
    return None


def read_list(answer: str, name: str, deep: int = 8) -> tuple[list, list[str]]:
    """(items, what was refused) of the list of this name in an answer."""
    parts = [*_FENCE.findall(answer), answer]
    for part in parts:
        try:
            whole = json.loads(part.strip().lstrip("﻿"))
        except (ValueError, RecursionError):
            continue
        found = _inside(whole, name, deep)
        return (found, []) if found is not None else ([], [f"no list {name}"])
    for part in parts:
        if m := re.search(rf'"{re.escape(name)}"\s*:\s*\[', part):
            return _items(part, m.end())
    # A string that holds JSON, cut off or with text around it.
    if deep and f'\\"{name}\\"' in answer:
        return read_list(re.sub(r'\\(["\\/])', r"\1", answer).replace("\\n", "\n"), name, deep - 1)
    return [], ["no JSON" if "{" not in answer else f"no list {name}"]


def _items(text: str, at: int) -> tuple[list, list[str]]:
    """The items of a list that begins here, as far as they can be read."""
    items, refused = [], []
    while True:
        at = re.compile(r"[\s,]*").match(text, at).end()
        if at >= len(text):
            return items, [*refused, "cut off"]
        if text[at] == "]":
            return items, refused
        try:
            value, at = _READER.raw_decode(text, at)
            items.append(value)
        except (ValueError, RecursionError):
            following = text.find("{", at + 1)
            if following < 0:
                return items, [*refused, "cut off"]
            refused.append("unreadable")
            at = following


def _text(item: dict, name: str) -> str | None:
    return item[name] if isinstance(item.get(name), str) else None


def _number(item: dict, name: str) -> float | None:
    value = item.get(name)
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) else None


def _checked(answer: str | None, name: str, one) -> dict:
    found, refused = read_list(answer or "", name)
    out, bad = [], [{"pos": None, "reason": r} for r in refused]
    for pos, item in enumerate(found):
        made = one(item) if isinstance(item, dict) else "no object"
        if isinstance(made, str):
            bad.append({"pos": pos, "reason": made})
        else:
            out.append({"pos": pos} | made)
    return {"items": out, "refused": bad}


def _entity(item: dict):
    if (text := _text(item, "text")) is None:
        return "no text"
    sure = _number(item, "confidence")
    return {"text": text, "entity_type": _text(item, "entityType"), "suggested": _text(item, "suggested"), "confidence": CONFIDENCE if sure is None else sure}


def _decision(item: dict):
    text, keep, sure = _text(item, "text"), item.get("keep"), _number(item, "confidence")
    if text is None or not isinstance(keep, bool) or sure is None:
        return "no text" if text is None else "no keep" if not isinstance(keep, bool) else "no confidence"
    said = _text(item, "suggested")
    return {"text": text, "keep": keep, "confidence": min(1.0, max(0.0, sure)), "entity_type": _text(item, "entityType"), "suggested": said if said is None or len(said) <= SUGGESTED else None}


def entities(answer) -> Column:
    """struct<items, refused>: the entities of an answer. Null and empty answers have none and are refused as such."""
    return F.udf(lambda t: _checked(t, "entities", _entity), ENTITIES, useArrow=True)(col(answer))


def decisions(answer, allowed=None) -> Column:
    """struct<items, refused>: the decisions of an answer; with allowed (array<string>), those on other texts are left out."""
    found = F.udf(lambda t: _checked(t, "decisions", _decision), DECISIONS, useArrow=True)(col(answer))
    return found if allowed is None else found.withField("items", F.filter(found["items"], lambda x: F.array_contains(col(allowed), x["text"])))
