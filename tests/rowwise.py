"""The resolver call by call, over lists, to hold the set-based one against."""

from __future__ import annotations

from graphloom.functions.names import BUILTINS


def matches(path: str, wanted: str) -> bool:
    return path == wanted or path.endswith("/" + wanted)


def resolve(call: dict, symbols: list[dict], names: list[dict], files: list[str]) -> tuple[object, str]:
    """(id, label) of one call with callee_name."""
    name, lang, file = call["callee_name"], call["lang"], call["file"]
    found = [s for s in symbols if s["name"] == name and s["lang"] == lang]
    if not found:
        return None, "unresolved"

    def one(rows):
        return (rows[0]["id"], "exact") if len(rows) == 1 else (None, "ambiguous")

    def imported(local):
        rows = sorted((n["seq"], n["source_module"]) for n in names if n["file"] == file and n["local"] == local)
        return rows[0][1].replace(".", "/") + ".py" if rows else None

    rc = call["receiver_class"]
    if call["call_kind"] == "method" and rc is not None:
        named = [s for s in symbols if s["name"] == rc and s["lang"] == lang]
        if not named:
            module = imported(rc)
            outside = rc in BUILTINS or (module is not None and not any(matches(f, module) for f in files))
            if len(found) > 1 and lang == "python" and outside:
                return None, "unresolved"
        elif len(named) == 1 and named[0]["kind"] == "class":
            own = [s for s in found if s["parent_class"] == rc]
            if own:
                return one(own)
            base = named[0]["base_class"]
            up = [s for s in symbols if s["name"] == base and s["lang"] == lang] if base else []
            inherited = [s for s in found if s["parent_class"] == base]
            if len(up) == 1 and up[0]["kind"] == "class" and len(inherited) == 1:
                return inherited[0]["id"], "exact"
    if call["call_kind"] == "func":
        top = [s for s in found if s["parent_class"] is None]
        module = imported(name)
        if module is not None:
            hit = [s for s in top if s["file"] == file or matches(s["file"], module)]
            if hit:
                return one(hit)
        here = [s for s in top if s["file"] == file]
        if here:
            return max(here, key=lambda s: s["seq"])["id"], "exact"
        if top:
            return one(top)
    return one(found)
