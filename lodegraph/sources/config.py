"""Configuration: TOML layers, list patches, command-line values, repository state."""

from __future__ import annotations

import re
import subprocess
import tomllib
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from lodegraph.functions.numeric import parse_number

VERSION = "5.0"
#: Order in which the operations of a list patch are applied.
_PATCH = ("replace_all", "clear", "remove", "replace", "after", "before", "prepend", "add")
_KNOWN = {"version", "ignore", "rules", "metrics", "principles", "report", "languages", "plugins", "output", "git"}


def patch_list(base: Sequence[Any], patch: Mapping[str, Any] | Sequence[Any]) -> list[Any]:
    """A list changed by a table of operations; a plain list replaces it. Doubles go at the end."""
    if not isinstance(patch, Mapping):
        return list(dict.fromkeys(patch))
    unknown = set(patch) - set(_PATCH)
    if unknown:
        raise ValueError(f"unknown list operation: {', '.join(sorted(unknown))}")
    if "replace_all" in patch:
        return list(dict.fromkeys(patch["replace_all"]))
    out = [] if patch.get("clear") else [x for x in base if x not in patch.get("remove", ())]
    out = [patch.get("replace", {}).get(x, x) for x in out]
    for place, shift in (("after", 1), ("before", 0)):
        for anchor, items in patch.get(place, {}).items():
            if anchor in out:  # an unknown anchor adds nothing
                at = out.index(anchor) + shift
                out[at:at] = items if isinstance(items, list) else [items]
    return list(dict.fromkeys([*patch.get("prepend", ()), *out, *patch.get("add", ())]))


def merge(base: Any, over: Any) -> Any:
    """Tables merge key by key; lists are patched by tables of operations; principles merge by id; all else is replaced."""
    if isinstance(base, Mapping) and isinstance(over, Mapping):
        return {k: merge(base[k], over[k]) if k in base and k in over else base.get(k, over.get(k)) for k in [*base, *(k for k in over if k not in base)]}
    if isinstance(base, list) and isinstance(over, Mapping):
        return patch_list(base, over)
    if isinstance(base, list) and isinstance(over, list) and all(isinstance(x, Mapping) and "id" in x for x in [*base, *over]):
        merged = {x["id"]: dict(x) for x in base}
        for x in over:
            merged[x["id"]] = merged.get(x["id"], {}) | dict(x)
        return list(merged.values())
    return over


def load(paths: Sequence[str | Path], base: Mapping[str, Any] | None = None, inline: Sequence[str] = ()) -> dict[str, Any]:
    """The layers of several files over a base, then inline ``a.b=value`` settings; an unknown top-level key is an error."""
    out: dict[str, Any] = dict(base or {})
    for path in paths:
        layer = tomllib.loads(Path(path).read_text("utf-8"))
        unknown = set(layer) - _KNOWN
        if unknown:
            raise ValueError(f"{path}: unknown key {', '.join(sorted(unknown))}")
        if layer.get("version", VERSION) != VERSION:
            raise ValueError(f"{path}: version {layer['version']} instead of {VERSION}")
        out = merge(out, layer)
    for setting in inline:
        key, _, value = setting.partition("=")
        try:
            parsed = tomllib.loads(f"v = {value}")["v"]
        except tomllib.TOMLDecodeError:
            parsed = value
        for name in reversed(key.split(".")):
            parsed = {name: parsed}
        out = merge(out, parsed)
    return out


def limits(table: Mapping[str, Any], known: set[str]) -> dict[str, float]:
    """Threshold limits, with K, M and G; a metric that isn't known is an error."""
    unknown = sorted(set(table) - known)
    if unknown:
        raise ValueError(f"no such metric: {', '.join(unknown)}")
    return {k: parse_number(v) for k, v in table.items()}


def resolve_languages(asked: Sequence[str], configured: Sequence[str], detected: Sequence[str], aliases: Mapping[str, Sequence[str]] = {}) -> list[str]:  # noqa: B006
    """Those asked for, else those configured, else those detected, in order; names may be aliases."""
    names = {a: k for k, v in aliases.items() for a in v}
    chosen = asked or configured or sorted(detected)
    return list(dict.fromkeys(names.get(n, n) for n in chosen))


def unique_extensions(languages: Mapping[str, Sequence[str]]) -> None:
    """An error if two languages claim one extension."""
    owner: dict[str, str] = {}
    for language, extensions in languages.items():
        for e in extensions:
            if owner.setdefault(e, language) != language:
                raise ValueError(f"{owner[e]} and {language} both claim .{e}")


def git_state(folder: str, override: Mapping[str, Any] | None = None) -> dict[str, Any] | None:
    """Branch, 12 characters of the commit, number of changed files and origin; a full override asks nobody."""
    if override and {"branch", "commit", "dirty_files"} <= set(override):
        return dict(override)

    def ask(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else None

    commit = ask("rev-parse", "HEAD")
    if commit is None:
        return dict(override) if override else None
    state = {"branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "commit": commit[:12], "dirty_files": len((ask("status", "--porcelain") or "").splitlines()), "origin": ask("remote", "get-url", "origin")}
    return state | dict(override or {})


def web_base(origin: str | None) -> str | None:
    """The web address of a repository from its remote."""
    m = re.match(r"(?:git@([^:/]+):|ssh://(?:[^@/]+@)?([^:/]+)(?::\d+)?/|https?://(?:[^@/]+@)?([^/]+)/)(.+?)(?:\.git)?/?$", origin or "")
    return f"https://{m[1] or m[2] or m[3]}/{m[4]}" if m else None


def blob_url(origin: str | None, commit: str, path: str, line: int | None = None) -> str | None:
    """The address of a file at a commit, at a line."""
    base = web_base(origin)
    return f"{base}/blob/{commit}/{path}{f'#L{line}' if line else ''}" if base else None
