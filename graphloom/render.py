"""Bundles as Markdown."""

from __future__ import annotations

from graphloom.functions.parse.registry import language


def unparsed_line(count: int, files: list[str]) -> str | None:
    return f"{count} files unparsed (graph incomplete): {', '.join(files)}" if count else None


def _fence(path: str, body: str) -> str:
    return f"```{language(path) or ''}\n{body}\n```\n"


def render_prompt(b: dict) -> str:
    t, r = b["target"], b["report"]
    out = [f"# Target: {t['fq_name']} ({t['file']}:{t['start_line']}-{t['end_line']})\n", _fence(t["file"], t["body"]), "## Direct callees\n"]
    for c in b["callees"]:
        if c["resolution"] == "exact":
            out.append(f"- `{c['signature'] or c['name']}`  ({c['file'] or '?'})\n")
        else:
            out.append(f"- `{c['name']}`  ({'unresolved/external' if c['resolution'] == 'unresolved' else 'ambiguous'})\n")
    out.append(f"## Callers ({r['caller_count']} total; {r['callers_included']} shown; tests first)\n")
    for c in b["callers"]:
        s = c["call_site"]
        out += [f"### {s['file']}:{s['line']} in {c['caller']}(){'   [TEST]' if c['is_test'] else ''}\n", _fence(s["file"], s["snippet"])]
    out.append(
        f"## Report\ntokens≈{r['token_count']} budget={r['budget']} over_budget={str(r['over_budget']).lower()}; omitted: {len(r['omitted'])} callers "
        f"({' '.join(r['omitted'])}); ambiguous: [{', '.join(r['ambiguous'])}]; unresolved: [{', '.join(r['unresolved'])}]\n"
    )
    if line := unparsed_line(r["unparsed_files_count"], r["unparsed_files"]):
        out.append(f"! {line}\n")
    return "".join(out)
