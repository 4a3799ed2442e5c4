"""Writing records, tables, reports and run metadata."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.config import Params
from stemmata.scratch import Scratch

#: column orders of the written tables (fixed values)
RECORD_COLUMNS = "work_i work_j era_i era_j author_i author_j title_i title_j score chain_len matched_words matched_words_j n_chained ref_i ref_j word_range_i word_range_j snippet_i snippet_j".split()
TAGGED_COLUMNS = "work_i ref_i era_i work_j ref_j era_j score chain_len matched_words snippet_i snippet_j author_i author_j title_i title_j tag".split()


def ndjson(df: DataFrame, path: str) -> None:
    """JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def tsv(df: DataFrame, path: str, columns: list[str] | None = None, newlines: bool = True) -> None:
    """Tab-separated with a header, unquoted: tabs become spaces, and so do line ends unless told otherwise."""
    signs = "\t\n\r" if newlines else "\t"
    cols = columns or df.columns
    kinds = dict(df.dtypes)
    text = [F.translate(c, signs, " " * len(signs)).alias(c) if kinds[c] == "string" else F.col(c) for c in cols]
    df.select(*text).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def packages(df: DataFrame, folder: str) -> None:
    """One table a package, by wp_key, in the order of match_id where there is one; ``readers.package_table`` reads them again."""
    kept = Scratch(df.sparkSession, "packages").put(df)  # so the packages are worked out once, not once a table
    for name in [r["wp_key"] for r in kept.select("wp_key").distinct().collect()]:  # a handful of packages
        one = kept.filter(F.col("wp_key") == name)
        tsv(one.orderBy("match_id") if "match_id" in df.columns else one, f"{folder}/{name}_clean.tsv", [c for c in TAGGED_COLUMNS if c in df.columns])


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small table for readers; every row has as many cells as the head, null is '–'. ``df`` is a report, ordered and limited by its query; of a longer one the table says that it is cut."""
    rows = df.limit(most + 1).collect()
    rest = ["", f"Only the first {most} rows are shown."] if len(rows) > most else []
    rows = rows[:most]
    cell = lambda v: "–" if v is None else str(v).replace("|", "/").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows] + rest) + "\n"


def report(title: str, parts: dict[str, DataFrame], notes: list[str] | None = None, path: str | None = None) -> str:
    """A report of several tables under their headings, written to ``path`` if that is given; a table without rows says so."""
    out = [f"# {title}", "", *[f"* {x}" for x in notes or []], ""]
    for heading, df in parts.items():
        text = markdown(df, heading)
        out.append("#" + text if text.count("\n| ") > 1 else f"## {heading}\n\nNone.\n")
    whole = "\n".join(out)
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(whole, encoding="utf-8")
    return whole


def numbers_json(parts: dict[str, DataFrame], path: str) -> dict[str, object]:
    """All reported counts as one JSON file: a table of one row as an object, of several as a list."""
    found: dict[str, object] = {}
    for name, df in parts.items():
        rows = [r.asDict(recursive=True) for r in df.collect()]  # aggregates
        found[name] = rows[0] if len(rows) == 1 else rows
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(found, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    return found


def run_meta(path: str, params: Params, diagnostics: dict[str, object], works: list[dict[str, object]], hashes: dict[str, str]) -> None:
    """The sidecar of a run: parameters, which were clamped, whether scores are of corpus scope, diagnostics, hashes of the inputs."""
    meta = {"generated": datetime.now(UTC).isoformat(), "requested": {k: v for k, v in vars(params).items() if k != "clamped"}, "clamped": params.clamped, "corpus_idf": params.idf_scope == "corpus", "diagnostics": diagnostics, "sha256": hashes, "works": works}
    Path(path).write_text(json.dumps(meta, ensure_ascii=False, indent=2), encoding="utf-8")
