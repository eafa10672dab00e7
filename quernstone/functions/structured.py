"""Structured text: line-hash chains, diffs, frontmatter, canonical JSON, repair of argument maps."""

from __future__ import annotations

import difflib
import json

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from ..sources.tables import table

# Fixed value: the letters that stand for the sixteen halves of a byte.
NIBBLES = "ZPMQVRWSNKTXJBYH"


def line_hashes(text: str | None) -> list[str]:
    """Two letters for each line, each hash seeded by the one before; a first line without letters and digits is seeded by its number."""
    out: list[str] = []
    for number, line in enumerate((text or "").split("\n"), 1):
        solid = "".join(line.removesuffix("\r").split())
        if out:
            seed = int.from_bytes(out[-1].encode(), "big")
        else:
            seed = 0 if any(map(str.isalnum, solid)) else number
        byte = xxhash.xxh32_intdigest(solid.encode("utf-8", "surrogatepass"), seed) % 256
        out.append(NIBBLES[byte // 16] + NIBBLES[byte % 16])
    return out


def apply_edits(text: str, edits: list[dict]) -> str:
    """Edits {line, end, hash, lines} in terms of the text's own line hashes: replace lines line..end; end = line - 1 inserts.

    Anchors must hold and ranges must not overlap; equal edits count once; they are applied from the bottom up.
    """
    lines, hashes = text.split("\n"), line_hashes(text)
    unique = {(e["line"], e["end"], e["hash"], tuple(e["lines"])) for e in edits}
    ordered = sorted(unique, key=lambda e: (e[0], e[1]))
    for a, b in zip(ordered, ordered[1:]):
        if b[0] <= a[1]:
            raise ValueError("edits overlap")
    for line, end, mark, new in reversed(ordered):
        if not 1 <= line <= len(lines) or hashes[line - 1] != mark:
            raise ValueError(f"line {line} has changed")
        lines[line - 1 : end] = new
    return "\n".join(lines)


def text_lines(text: str | None) -> list[str]:
    """Lines between line feeds, numbered as for line_hashes; none follows a last line feed. An empty text is one empty line, a missing one has none."""
    return [] if text is None else text.removesuffix("\n").split("\n")


class Changes(difflib.SequenceMatcher):
    """Steps from lines a to lines b: equal ones at both ends stay, only those between are compared, frequent lines like all others."""

    def __init__(self, a: list[str], b: list[str]):
        least = min(len(a), len(b))
        self.head = next((n for n in range(least) if a[n] != b[n]), least)
        self.tail = next((n for n in range(least - self.head) if a[-1 - n] != b[-1 - n]), least - self.head)
        self.all_a, self.all_b = len(a), len(b)
        super().__init__(None, a[self.head : len(a) - self.tail], b[self.head : len(b) - self.tail], autojunk=False)

    def get_opcodes(self) -> list[tuple[str, int, int, int, int]]:
        h, t = self.head, self.tail
        first = [("equal", 0, h, 0, h)] if h else []
        last = [("equal", self.all_a - t, self.all_a, self.all_b - t, self.all_b)] if t else []
        return first + [(tag, i + h, j + h, k + h, m + h) for tag, i, j, k, m in super().get_opcodes()] + last


def unified(a: str | None, b: str | None, context: int = 3, most: int = 10_000) -> str:
    """A unified diff; numbers of lines alone where more than `most` lie between the equal ends of the texts."""
    x, y = text_lines(a), text_lines(b)
    changes = Changes(x, y)
    if max(len(changes.a), len(changes.b)) > most:
        return f"{len(x)} lines against {len(y)}"
    stretch = lambda i, j: f"{i + 1}" if j == i + 1 else f"{i + (j > i)},{j - i}"
    out = []
    for group in changes.get_grouped_opcodes(context):
        (_, i, _, k, _), (_, _, j, _, m) = group[0], group[-1]
        out.append(f"@@ -{stretch(i, j)} +{stretch(k, m)} @@")
        for tag, i, j, k, m in group:
            out += [f" {s}" for s in x[i:j]] if tag == "equal" else [f"-{s}" for s in x[i:j]] + [f"+{s}" for s in y[k:m]]
    return "\n".join(["--- a", "+++ b", *out] if out else [])


def canonical(text: str | None) -> str | None:
    """JSON with keys sorted at every level; what is not JSON stays."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (TypeError, ValueError):
        return text


def repaired(args: dict[str, object], fields: dict[str, tuple[float, float] | None], aliases: dict[str, str]) -> dict[str, object]:
    """Keys by alias, then by likeness (0.75 from eight letters on, else 0.8, both of four at least); numbers clamped to their field's bounds."""
    out: dict[str, object] = {}
    for key, value in args.items():
        name = key if key in fields else aliases.get(key)
        if name is None and len(key) >= 4:
            found = difflib.get_close_matches(key, [f for f in fields if len(f) >= 4 and f not in args], 1, 0.75 if len(key) >= 8 else 0.8)
            name = found[0] if found else None
        bounds = fields.get(name) if name else None
        if bounds and isinstance(value, (int, float)) and not isinstance(value, bool):
            value = min(max(value, bounds[0]), bounds[1])
        out.setdefault(name or key, value)
    return out


def frontmatter(text: Column) -> Column:
    """The block between two lines of ---, null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, r"\A\s*---[ \t]*\n([\s\S]*?)\n?---[ \t]*(?:\n|\z)", 1)), F.lit(""))


def _udf(fn, kind: str):
    def run(a: pd.Series) -> pd.Series:
        return a.map(fn)

    return F.pandas_udf(run, kind)


def q_line_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    hashed = _udf(line_hashes, "array<string>")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(hashed(F.coalesce("text", F.lit("")))).alias("at", "hash")).select("doc_id", (F.col("at") + 1).alias("line_no"), "hash")


def q_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties with a second key put in front, in canonical form."""
    ship(spark)
    raw = F.concat(F.lit('{"z": 1, "a": '), "props", F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", _udf(canonical, "string")(raw).alias("args"))


def q_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\nlang: "), "lang", F.lit("\n---\n"))).otherwise(""), "text")
    return table(spark, sf_dir, "documents").select("doc_id", frontmatter(text).alias("meta"))


QUERIES = {"w18_line_hash_chain": q_line_hashes, "c37_canonical_json": q_canonical, "c26_frontmatter": q_frontmatter}
ORACLES = {
    "c37_canonical_json": "SELECT event_id, '{\"a\":{\"k\":' || json_extract_string(props, '$.k') || '},\"z\":1}' AS args FROM events",
    "c26_frontmatter": r"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) ELSE '' END || text AS t FROM documents) SELECT doc_id, nullif(trim(regexp_extract(t, '^\s*---[ \t]*\n([\s\S]*?)\n?---[ \t]*(?:\n|$)', 1)), '') AS meta FROM d",
}
