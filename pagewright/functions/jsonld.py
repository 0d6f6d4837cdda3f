"""Checks of structured-data blocks. Truth of a JSON value is a script's: null, false, 0 and '' are false."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLES = ("Article", "NewsArticle", "BlogPosting")
ARTICLE_FIELDS = ("headline", "author", "datePublished", "image")


def _is_object(item) -> bool:
    return isinstance(item, (dict, list))


def _get(item, key):
    return item.get(key) if isinstance(item, dict) else None


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _bad_question(entry) -> bool:
    answer = _get(entry, "acceptedAnswer")
    right = _get(entry, "@type") == "Question" and isinstance(_get(entry, "name"), str)
    return not (right and _get(answer, "@type") == "Answer" and isinstance(_get(answer, "text"), str))


def _bad_crumb(entry) -> bool:
    right = _get(entry, "@type") == "ListItem" and _number(_get(entry, "position")) and isinstance(_get(entry, "name"), str)
    has_item = isinstance(entry, dict) and "item" in entry and (entry["item"] is None or isinstance(entry["item"], (str, dict, list)))
    return not (right and has_item)


def _kind(value) -> str:
    """What a script's ``typeof`` says of a value that may be missing."""
    if value is _MISSING:
        return "undefined"
    if isinstance(value, bool):
        return "boolean"
    return "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "object"


_MISSING = object()


def _list_evidence(block: dict, field: str, bad, kind: str, names: tuple[str, str, str]) -> dict | None:
    items = block.get(field, _MISSING)
    if not isinstance(items, list) or not items:
        return {"schemaType": kind, names[0]: _kind(items)}
    wrong = sum(map(bad, items))
    return {names[1]: wrong, names[2]: len(items)} if wrong else None


def block_evidence(blocks: list) -> dict[str, dict]:
    """Evidence per structured-data rule that parsed blocks break, SD-001 and SD-007 aside; the first block that breaks a
    rule about one type is shown."""
    of_type = lambda *names: [b for b in blocks if isinstance(b, dict) and b.get("@type") in names]
    first = lambda found: next((f for f in found if f), None)
    untyped = sum(not isinstance(b, dict) or "@type" not in b for b in blocks)
    bare = sum(not _is_object(b) or not _get(b, "@context") for b in blocks)
    unusable = [i for i, b in enumerate(blocks) if b is None or isinstance(b, str) or (_is_object(b) and not b)]
    foreign = [
        {"index": i, "context": _get(b, "@context")}
        for i, b in enumerate(blocks)
        if _is_object(b) and not (isinstance(_get(b, "@context"), str) and "schema.org" in b["@context"])
    ]
    lacking = lambda b, names: [n for n in names if not _get(b, n)]
    article = first({"schemaType": b["@type"], "missingFields": lacking(b, ARTICLE_FIELDS)} if lacking(b, ARTICLE_FIELDS) else None for b in of_type(*ARTICLES))
    offers = [b["offers"] for b in of_type("Product") if _is_object(b.get("offers"))]
    price = ("price", "priceCurrency")
    found = {
        "SD-002": {"totalBlocks": len(blocks), "missingTypeCount": untyped} if untyped else None,
        "SD-003": {"totalBlocks": len(blocks), "missingContextCount": bare} if bare else None,
        "SD-004": {"schemaType": "Organization", "missingProperty": "name"} if any(not b.get("name") for b in of_type("Organization")) else None,
        "SD-005": article,
        "SD-006": {"schemaType": "Product", "missingProperty": "offers"} if any(b.get("offers") is None for b in of_type("Product")) else None,
        "SD-008": {"totalBlocks": len(blocks), "invalidBlockIndices": unusable} if unusable else None,
        "SD-009": {"invalidContextCount": len(foreign), "invalidContexts": foreign} if foreign else None,
        "SD-010": first(_list_evidence(b, "mainEntity", _bad_question, "FAQPage", ("mainEntityType", "invalidQuestionCount", "totalQuestions")) for b in of_type("FAQPage")),
        "SD-011": first(_list_evidence(b, "itemListElement", _bad_crumb, "BreadcrumbList", ("itemListElementType", "invalidEntryCount", "totalEntries")) for b in of_type("BreadcrumbList")),
        "SD-012": first({"missingFields": lacking(o, price)} if lacking(o, price) else None for o in offers),
    }
    return {rule: shown for rule, shown in found.items() if shown}


def block_rules(blocks: list) -> list[str]:
    """Ids of the structured-data rules that parsed blocks break, SD-001 and SD-007 aside."""
    return list(block_evidence(blocks))


def _parsed(texts) -> list:
    out = []
    for text in texts if texts is not None else ():
        try:
            out.append(json.loads(text))
        except (TypeError, ValueError):
            continue
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def block_findings(blocks: pd.Series) -> pd.Series:
    """Structured-data rules that a page's JSON texts break, with their evidence as JSON; texts that do not parse are left out."""
    shown = lambda value: json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return pd.Series([{rule: shown(value) for rule, value in block_evidence(_parsed(texts)).items()} for texts in blocks])


@F.pandas_udf(T.ArrayType(T.StringType()))
def block_types(blocks: pd.Series) -> pd.Series:
    """Distinct string types of the blocks, those in arrays of types too, in order of appearance."""
    out = []
    for texts in blocks:
        names = []
        for block in _parsed(texts):
            kind = _get(block, "@type")
            names += [k for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str)]
        out.append(list(dict.fromkeys(names)))
    return pd.Series(out)


@F.pandas_udf(T.BooleanType())
def valid_blocks(blocks: pd.Series) -> pd.Series:
    """At least one block, and each has a schema.org context and a type that is a text or a list of texts."""

    def good(block) -> bool:
        context, kind = _get(block, "@context"), _get(block, "@type")
        named = isinstance(kind, str) and kind != "" or isinstance(kind, list) and len(kind) > 0 and all(isinstance(k, str) for k in kind)
        return isinstance(context, str) and "schema.org" in context and named

    return pd.Series([bool(p) and all(map(good, p)) for p in map(_parsed, blocks)])
