"""Tables as self-contained pages."""

from __future__ import annotations

import html
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = '<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><p>{at}</p><input id="q" placeholder="filter"><table><thead><tr>{heads}</tr></thead><tbody>\n'
FOOT = """</tbody></table><script type="application/json" id="rows">{rows}</script><script>
const body = document.querySelector("tbody"), all = [...body.rows];
document.getElementById("q").oninput = e => all.forEach(r => r.hidden = !r.textContent.toLowerCase().includes(e.target.value.toLowerCase()));
document.querySelectorAll("th").forEach((h, i) => { let up = 1; h.onclick = () => { all.sort((a, b) => up * a.cells[i].textContent.localeCompare(b.cells[i].textContent, undefined, {numeric: true})).forEach(r => body.append(r)); up = -up; }; });
</script></body></html>"""


def script_safe(text: str) -> str:
    """JSON that cannot end the script element around it."""
    return text.replace("</", "<\\/")


def page(rows: DataFrame, title: str, at: str, labels: dict[str, str]) -> Iterator[str]:
    """Pieces of a page with the columns of ``labels``; null is blank. Rows come one partition at a time, once for the table and once as JSON."""
    out = rows.select(*labels)
    yield HEAD.format(title=html.escape(title), at=html.escape(at), heads="".join(f"<th>{html.escape(x)}</th>" for x in labels.values()))
    for r in out.toLocalIterator():
        yield "<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>\n"
    before, after = FOOT.split("{rows}")
    yield before + "["
    for i, r in enumerate(out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()):
        yield ("," if i else "") + script_safe(r[0])
    yield "]" + after
