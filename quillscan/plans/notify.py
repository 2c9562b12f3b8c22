"""Notifications: which targets fire, what they are sent, and the sending itself through an injectable transport."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Sequence

from quillscan.plans.report import Outcome, plural
from quillscan.sources.config import Target, rank_or_low

Transport = Callable[[str, bytes], None]
TOOL = "Quillscan"
TOP = 8


def fires(target: Target, o: Outcome) -> bool:
    """A target wants the event (any finding, or a block), and the most severe finding reaches its threshold."""
    if not o.findings:
        return False
    wanted = "finding" in target.events or ("block" in target.events and o.verdict == "BLOCK")
    return wanted and max(rank_or_low(f["severity"]) for f in o.findings) >= rank_or_low(target.threshold)


def generic(o: Outcome) -> dict:
    keep = ("rule_id", "rule_name", "description", "severity", "file", "line", "deobfuscated")
    return {"subject": o.subject, "score": o.score, "risk_level": o.level.lower(), "verdict": o.verdict, "tags": list(o.tags), "finding_count": len(o.findings), "findings": [{k: f[k] for k in keep} for f in o.findings]}


def summary(o: Outcome) -> str:
    return f"{o.subject} — {o.verdict} ({o.score}/100, {plural(len(o.findings), 'finding')})"


def _line(f: dict) -> str:
    return f"• [{f['severity'].upper()}] {f['rule_id']} {f['rule_name']}"


def top(o: Outcome, limit: int = TOP) -> str:
    return "\n".join(map(_line, o.findings[:limit]))


def slack(o: Outcome) -> dict:
    sign = ":no_entry:" if o.verdict == "BLOCK" else ":warning:"
    tags = f"\nTags: {' '.join(o.tags)}" if o.tags else ""
    body = f"{sign} *{TOOL} verdict: {o.verdict}*\n*{o.subject}*  —  score *{o.score}/100* ({o.level})\n{top(o)}{tags}"
    return {"text": f"{sign} *{TOOL}* — {summary(o)}", "blocks": [{"type": "section", "text": {"type": "mrkdwn", "text": body}}]}


def discord(o: Outcome) -> dict:
    color = {"CRITICAL": 0xFF5C5C, "HIGH": 0xF2854E, "MEDIUM": 0xF2C14E}.get(o.level, 0x3DDC97)
    field = lambda name, value, inline: {"name": name, "value": value, "inline": inline}
    fields = [field("Score", f"{o.score}/100 ({o.level})", True), field("Findings", str(len(o.findings)), True), field("Tags", " ".join(o.tags) or "—", False)]
    return {"content": f"{TOOL} — {summary(o)}", "embeds": [{"title": f"{o.verdict} — {o.subject}", "description": top(o), "color": color, "fields": fields}]}


def telegram(o: Outcome, chat_id: str | None) -> dict:
    lines = []
    for f in o.findings[:TOP]:
        snippet = f["snippet"].strip()
        line = f"{_line(f)}  —  L{f['line']}{' (deobfuscated)' * f['deobfuscated']}"
        lines.append(line + (f"\n    {snippet[:160]}{'…' * (len(snippet) > 160)}" if snippet else ""))
    sign = "\U0001f6ab" if o.verdict == "BLOCK" else "⚠️"
    tags = "\n" + "  ".join(o.tags) if o.tags else ""
    text = f"{sign} {TOOL} — {o.verdict}\n{o.subject}\nScore: {o.score}/100 ({o.level}) · {len(o.findings)} finding(s)\n\n{chr(10).join(lines)}{tags}"
    return {"chat_id": chat_id or "", "text": text, "disable_web_page_preview": True}


def payload(target: Target, o: Outcome) -> dict:
    return {"slack": slack, "discord": discord}.get(target.format, generic)(o) if target.format != "telegram" else telegram(o, target.chat_id)


def post(url: str, body: bytes) -> None:
    urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=20).close()


def dispatch(targets: Sequence[Target], o: Outcome, transport: Transport = post) -> list[str | None]:
    """Sends to every target that fires; for each of these the error, or None. One failure doesn't stop the others."""
    results: list[str | None] = []
    for t in targets:
        if not fires(t, o):
            continue
        if t.format == "telegram":
            url = f"https://api.telegram.org/bot{t.token}/sendMessage" if t.token and t.chat_id else None
        else:
            url = t.url
        if not url:
            results.append("token and chat_id are missing" if t.format == "telegram" else "url is missing")
            continue
        try:
            transport(url, json.dumps(payload(t, o), ensure_ascii=False).encode())
            results.append(None)
        except Exception as e:  # noqa: BLE001  the transport's own errors are the result
            results.append(f"{type(e).__name__}: {e}")
    return results
