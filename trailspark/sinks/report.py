"""A standalone HTML report over bounded rows of a case."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions import scalars as S
from trailspark.operators import views

PAGE = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Agent activity report</title>
<style>body{{font:14px system-ui;margin:24px}}table{{border-collapse:collapse;width:100%}}td,th{{border:1px solid #ccd;padding:4px;vertical-align:top;text-align:left}}pre{{white-space:pre-wrap}}</style></head><body>
<h1>Agent activity report</h1><p>{note}</p>{cards}
<label>Search <input id="q"></label><section id="view"></section>
<script>const CASE={data};
const cell=v=>{{const d=document.createElement('td');d.textContent=v===null||v===undefined?'':typeof v==='object'?JSON.stringify(v):v;return d}};
function table(title,rows){{const s=document.createElement('section'),h=document.createElement('h2'),t=document.createElement('table');h.textContent=title+' ('+rows.length+')';s.append(h,t);
if(rows.length){{const keys=Object.keys(rows[0]),r=t.insertRow();keys.forEach(k=>{{const d=document.createElement('th');d.textContent=k;r.append(d)}});rows.forEach(x=>{{const r=t.insertRow();keys.forEach(k=>r.append(cell(x[k])))}})}}return s}}
function show(){{const q=document.getElementById('q').value.toLowerCase(),v=document.getElementById('view');v.replaceChildren(...Object.entries(CASE).map(([k,rows])=>table(k,rows.filter(x=>!q||JSON.stringify(x).toLowerCase().includes(q)))))}}
document.getElementById('q').oninput=show;show();</script></body></html>"""


def _rows(df: DataFrame, n: int) -> list[dict]:
    return [json.loads(r["j"]) for r in df.limit(n).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]


def render(events: DataFrame, replay: DataFrame, iocs: DataFrame, stats: dict, diagnostics: DataFrame, limit: int) -> str:
    """The page with embedded JSON, in which no end tag can close the script."""
    shown = events.orderBy("event_number").select("event_number", S.timeline_time(F.col("timestamp_utc")).alias("time"), "agent", "event_type", "summary", "session_key", views.badge().alias("badge"), views.risks().alias("risks"), "source_file", "source_line")
    data = {"Replay": _rows(replay, limit), "Timeline": _rows(shown, limit), "Sessions": _rows(views.sessions(events).orderBy("first_event"), limit), "Secrets": _rows(views.secret_records(events), limit),
            "Indicators": _rows(iocs, limit), "Diagnostics": _rows(diagnostics, limit)}
    cards = "<ul>" + "".join(f"<li>{html.escape(str(k))}: {html.escape(str(v))}</li>" for k, v in stats.items() if isinstance(v, (int, str))) + "</ul>"
    return PAGE.format(note=f"Each table shows at most {limit} rows; the CSV and JSON files are whole.", cards=cards, data=json.dumps(data, ensure_ascii=False).replace("</", "<\\/"))
