"""A package as plain text. Works on the collected package (at most 18 items)."""

from __future__ import annotations

import shutil
import sys
import textwrap

SHOWN, VERBOSE_LINES = 8, 9
PATH_COLUMN, LEAST_REASON, LEAST_PATH = 48, 28, 16
LABELS = {
    "ignored": "ignored by rules", "oversize": "too large", "binary": "binary", "duplicate": "duplicate copies", "below_threshold": "below the relevance threshold",
    "over_cap": "relevant, beyond the delivery limit", "no_excerpt": "relevant, nothing to excerpt", "over_budget": "relevant, beyond the byte budget",
}


def _glyphs(unicode_ok: bool) -> dict:
    return {"dot": "·", "via": "↳", "cut": "…"} if unicode_ok else {"dot": "-", "via": "<-", "cut": "..."}


def stdout_is_unicode() -> bool:
    try:
        "·↳…".encode(sys.stdout.encoding or "ascii")
    except (UnicodeError, LookupError):
        return False
    return True


def elide(path: str, width: int, cut: str) -> str:
    """The path with its middle left out where it is too long; the file name's end stays."""
    if len(path) <= width:
        return path
    room = max(width - len(cut), 2)
    tail = max(room * 2 // 3, 1)
    return path[: room - tail] + cut + path[-tail:]


def shorten(text: str, width: int, cut: str) -> str:
    return text if len(text) <= width else text[: max(width - len(cut), 0)].rstrip() + cut


def _via(item: dict) -> str | None:
    """The other file of the last relation, by its name."""
    if not item["provenance"]:
        return None
    a, b = item["provenance"][-1].split(" imports ")
    return (b if a == item["path"] else a).rsplit("/", 1)[-1]


def columns(paths: list[str], width: int) -> tuple[int, int, bool]:
    """(path width, reason width, wrap): the path column shrinks down to LEAST_PATH to leave the reason
    LEAST_REASON; below that the reason goes on a line of its own."""
    want = min(max(map(len, paths), default=LEAST_PATH), PATH_COLUMN)
    path = max(min(want, width - 4 - LEAST_REASON), LEAST_PATH)
    if width - 4 - path >= LEAST_REASON:
        return path, width - 4 - path, False
    return max(width - 2, LEAST_PATH), max(width - 6, LEAST_REASON), True


def _items(items: list[dict], width: int, g: dict, verbose: bool) -> list[str]:
    path_w, reason_w, wrap = columns([x["path"] for x in items], width)
    out = []
    for x in items:
        via = _via(x)
        reason = x["reason"] + (f"  {g['via']} via {via}" if via else "")
        path, reason = elide(x["path"], path_w, g["cut"]), shorten(reason, reason_w, g["cut"])
        out += [f"  {path}", f"      {reason}"] if wrap else [f"  {path:<{path_w}}  {reason}"]
        if verbose:
            out += _excerpts(x, g)
    return out


def _excerpts(item: dict, g: dict) -> list[str]:
    hits = lambda e: sum(e["text"].lower().count(t) for t in item["matched_terms"])
    out = []
    for e in sorted(item["excerpts"], key=lambda e: (-hits(e), e["start_line"])):
        body = e["text"].splitlines()
        room = VERBOSE_LINES - len(out) - 1
        if room < 1:
            break
        out.append(f"    lines {e['start_line']}-{e['end_line']}")
        out += [f"      {line}" for line in body[:room]]
        if len(body) > room:
            out[-1] = f"      {g['cut']}"
    return out


def _weak(signal: dict) -> list[str]:
    said = ", ".join(f"'{t}' ({n} names)" for t, n in signal["matched_terms"].items())
    rest = ", ".join(f"'{t}' in {n}" for t, n in signal["term_file_counts"].items() if t not in signal["matched_terms"])
    lines = [f"Weak match: only {said} matched, which is common here."]
    if rest:
        lines.append(f"Files per other term: {rest}.")
    return [*lines, "Name a file, class or function to narrow it.", "", "Showing weak matches anyway:", ""]


def render(package: dict, verbose: bool = False, show_all: bool = False, width: int | None = None, unicode_ok: bool | None = None) -> str:
    g = _glyphs(stdout_is_unicode() if unicode_ok is None else unicode_ok)
    width = width or shutil.get_terminal_size((100, 24)).columns
    items = package["included"]
    out = [package["task"], f"{len(items)} relevant {g['dot']} {package['excluded_count']} excluded", ""]
    shown = items if show_all else items[:SHOWN]
    if items:
        out += (_weak(package["weak_signal"]) if package["weak_signal"] else []) + _items(shown, width, g, verbose)
    else:
        out.append("No relevant context found for this task.")
    findings = [f"  {x['message']}" for x in (*package["conflicts"], *package["missing"])]
    out += ["", *[line for f in findings for line in textwrap.wrap(f, width, subsequent_indent="    ")]] if findings else []
    hints = [f"{len(items) - len(shown)} more with --all"] if len(items) > len(shown) else []
    hints += ["excerpts with -v"] if items and not verbose else []
    out += ["", f" {g['dot']} ".join(hints)] if hints else []
    reasons = {k: n for k, n in package["excluded_by_reason"].items() if n}
    order = sorted(reasons, key=lambda k: (k not in ("over_cap", "no_excerpt", "over_budget"), -reasons[k]))
    out += ["", *[f"  {reasons[k]} {LABELS[k]}" for k in order]] if reasons else []
    dropped = package["trace"]["excerpts_dropped_over_budget"]
    ran = ", ".join(package["trace"]["rules_run"]) or "none"
    out += ["", f"Checks run: {ran}" + (f"; {dropped} excerpts dropped over budget" if dropped else "")]
    return "\n".join(out)
