"""Markdown reports over small results: retrieval evaluations, comparisons of models, clusters."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import text
from lumenfold.runtime import collect_bounded

MOST = 10_000


def facts(pairs: dict[str, Any], *, code: bool = True) -> str:
    """One line for each fact; values as code, but those that begin with a blank."""
    return "\n".join(f"- {k}: {str(v).strip() if not code or str(v).startswith(' ') else f'`{v}`'}" for k, v in pairs.items())


def fenced(body: str, kind: str = "text", ticks: int = 4) -> str:
    return f"{'`' * ticks}{kind}\n{body.rstrip()}\n{'`' * ticks}"


def as_json(value: Any) -> str:
    return fenced(json.dumps(value, indent=2, ensure_ascii=False), "json", 3)


def table(rows: list, columns: dict[str, str]) -> str:
    """Rows (dicts) as a table; ``columns`` maps each to ``text`` or to a number format, which aligns to the right."""
    cell = lambda v, f: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ") if f == "text" else format(v, f)
    head = [f"| {' | '.join(c.replace('_', ' ') for c in columns)} |", f"|{'|'.join('---' if f == 'text' else '---:' for f in columns.values())}|"]
    return "\n".join([*head, *(f"| {' | '.join(cell(r[c], f) for c, f in columns.items())} |" for r in rows)])


def texts(rows: list) -> list[str]:
    """The text of each hit below a line with its rank, key and date."""
    out = ["### Retrieved dream texts"]
    for r in rows:
        out += [f"#### {r['rank']}. {r['dream_id']} — {r['date']}", fenced(r["text"] or "")]
    return out


def joined(parts: Iterable[str | None]) -> str:
    return "\n\n".join(p for p in parts if p) + "\n"


def _rows(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in collect_bounded(df.orderBy(*order), MOST, "a report")]


def retrieval_report(about: dict[str, Any], runs: DataFrame, hits: DataFrame, summary: DataFrame, *, target_text: str | None = None) -> str:
    """Evaluation of retrieval by embedding model.

    ``runs``: embed_model, collection_name, status, retrieval_seconds, error_type, error; ``hits``: embed_model, rank,
    dream_id, date, text, and where they were judged distance, relevance, generic_overlap, reason; ``summary``: embed_model,
    mean_relevance, median_relevance, relevant, judged.
    """
    found, means = {}, {r["embed_model"]: r for r in _rows(summary, "embed_model")}
    for h in _rows(hits, "embed_model", "rank"):
        found.setdefault(h["embed_model"], []).append(h)
    out: list[str | None] = ["# Retrieval evaluation", facts(about), "## Target dream text" if target_text else None, fenced(target_text) if target_text else None]
    for r in _rows(runs, "embed_model"):
        own, m = found.get(r["embed_model"], []), means.get(r["embed_model"])
        say = {"Collection": r["collection_name"], "Status": r["status"], "Retrieval time": f" `{r['retrieval_seconds']}` seconds"}
        out.append(f"## {r['embed_model']}")
        if r["status"] == "error":
            out += [facts(say), f"**{r['error_type']}:** {r['error']}", *(texts(own) if own else [])]
            continue
        if m:
            say |= {"Mean relevance": m["mean_relevance"], "Median relevance": m["median_relevance"], "Scores of 4–5": f"{m['relevant']}/{m['judged']}"}
        shown = [h | {"focal_relevance": h["relevance"]} for h in own]
        out += [facts(say), table(shown, {"rank": "d", "dream_id": "text", "date": "text", "distance": ".4f", "focal_relevance": "d", "generic_overlap": "d", "reason": "text"}), *texts(own)]
    return joined(out)


def comparison_report(about: dict[str, Any], prompt: dict[str, Any], settings: dict[str, Any], runs: DataFrame, hits: DataFrame, *, score: str = "distance", target_text: str | None = None) -> str:
    """Answers of each chat model with each index.

    ``runs``: model, index_name, collection_name, status, answer, error_type, error, retrieval_seconds, generation_seconds;
    ``hits``: index_name, rank, dream_id, date, text and the column ``score``.
    """
    found: dict[str, list] = {}
    for h in _rows(hits, "index_name", "rank"):
        found.setdefault(h["index_name"], []).append(h)
    out: list[str | None] = ["# Model comparison", facts(about), "## Prompt", as_json(prompt), "## Settings", as_json(settings), "## Target dream text" if target_text else None, fenced(target_text) if target_text else None]
    for i, r in enumerate(_rows(runs, "index_name", "model"), 1):
        total = round((r["retrieval_seconds"] or 0) + (r["generation_seconds"] or 0), 3)
        out += [f"## {i}. {r['model']} + {r['index_name']}", facts({"Collection": r["collection_name"], "Status": r["status"]} | {f"{k} time": f" `{v}` seconds" for k, v in (("Retrieval", r["retrieval_seconds"]), ("Generation", r["generation_seconds"]), ("Total", total))})]
        own = found.get(r["index_name"], [])
        if own:
            out += [table(own, {"rank": "d", "dream_id": "text", "date": "text", score: ".4f"}), *texts(own)]
        out += ["### Response", r["answer"].rstrip() if r["status"] in ("ok", "completed") else f"**{r['error_type']}:** {r['error']}"]
    return joined(out)


def cluster_report(about: dict[str, Any], settings: dict[str, Any], sizes: DataFrame, terms: DataFrame, tags: DataFrame, members: DataFrame) -> str:
    """Clusters with their terms, tags and typical members.

    ``sizes``: label, cluster_label, size; ``terms``: label, rank, term; ``tags``: label, rank, tag, n, lift; ``members``: label,
    rank, dream_id, date, text.
    """
    by: dict[str, dict[int, list]] = {k: {} for k in ("terms", "tags", "members")}
    short = members.withColumn("text", F.substring(text.compact(F.col("text")), 1, 400))
    for k, df in (("terms", terms), ("tags", tags), ("members", short)):
        for r in _rows(df, "label", "rank"):
            by[k].setdefault(r["label"], []).append(r)
    out = ["# Dream embedding cluster report", facts(about), "## Settings", as_json(settings), "> Cluster labels are descriptive summaries of shared content, not psychological interpretations."]
    for c in _rows(sizes, "label"):
        own = {k: v.get(c["label"], []) for k, v in by.items()}
        tag = ", ".join(f"`{t['tag']}` ({t['lift']:.1f}× baseline; {t['n']})" for t in own["tags"]) or "none"
        out += [f"## Cluster {c['label']}: {c['cluster_label']}", f"Dreams: {c['size']}", f"Distinctive terms: {', '.join(t['term'] for t in own['terms']) or 'none'}", f"Overrepresented tags: {tag}", "Representative dreams:"]
        out.append("\n".join(f"- **{m['dream_id']}** ({m['date'] or 'unknown'}): {m['text'] or ''}" for m in own["members"]))
    return joined(out)
