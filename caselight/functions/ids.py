"""Content-addressed ids: digests of compact JSON arrays, the same in tasks and on the driver."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def text_digest(text: str) -> str:
    return hashlib.sha256(unicodedata.normalize("NFC", text).replace("\r\n", "\n").strip().encode()).hexdigest()


def snapshot_id(corpus: str, version_ids: list[str]) -> tuple[str, str]:
    """Id and manifest hash of a set of document versions, whatever their order and repeats."""
    manifest = digest("snapshot-manifest", corpus, tuple(sorted(set(version_ids))))
    return f"snap_{manifest[:32]}", manifest


def _quoted(value: Column) -> Column:
    """A JSON string, or null; to_json escapes like the digests need for text without slashes."""
    return F.coalesce(F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", ""), F.lit("null"))


def prefixed_id(prefix: str, kind: str, *parts: Column) -> Column:
    """`prefix` and 32 hex digits of the digest of a JSON array of kind and parts."""
    body = F.concat_ws(",", F.lit(json.dumps(kind)), *map(_quoted, parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat(F.lit("["), body, F.lit("]")), 256), 1, 32))


def fragment_id(version: Column, page: int | Column, section: Column, anchor: Column, text_hash: Column) -> Column:
    """The id of a fragment on one page, from its version, section, anchor and the hash of its text."""
    body = F.concat_ws(",", F.lit('"fragment"'), _quoted(version), *[F.lit(page).cast("string")] * 2, *map(_quoted, (section, anchor, text_hash)))
    return F.concat(F.lit("frag_"), F.substring(F.sha2(F.concat(F.lit("["), body, F.lit("]")), 256), 1, 32))


#: The bytes of a text that the single-byte Cyrillic code page can write, or nothing.
def _as_bytes(text: str) -> bytes:
    found = text.encode("cp1251", "ignore")
    return found if len(found) == len(text) else b""


def repaired_text(text: str) -> str:
    """UTF-8 that was read as a single-byte Cyrillic code page, read right; any other text as it is."""
    read = _as_bytes(text).decode("utf-8", "replace")
    return text if not read or "\ufffd" in read else read


def _hashes(texts: pd.Series) -> pd.Series:
    return texts.map(text_digest, na_action="ignore")


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repaired_text, na_action="ignore")


def text_hash(text: Column) -> Column:
    """text_digest in Arrow batches: the composed form needs Python."""
    return F.pandas_udf(_hashes, "string")(text)


def composed(text: Column) -> Column:
    """Unicode composed form."""
    return F.pandas_udf(_composed, "string")(text)


def repaired(text: Column) -> Column:
    return F.pandas_udf(_repaired, "string")(text)


def canonical_hash(facts: Column) -> Column:
    """Digest of a struct whose fields are in sorted order, nulls included."""
    return F.sha2(F.to_json(facts, {"ignoreNullFields": "false"}), 256)
