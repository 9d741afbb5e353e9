"""The files of a review, and exports as files."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.tables import write_csv

PAGE = """<!doctype html>
<meta charset="utf-8">
<title>Review</title>
<script type="application/json" id="manifest">{manifest}</script>
<main></main>
<script>
const data = JSON.parse(document.getElementById("manifest").textContent), chosen = new Map();
const main = document.querySelector("main");
for (const group of data.groups) {{
  const box = main.appendChild(document.createElement("section"));
  box.appendChild(document.createElement("h2")).textContent = `${{group.group_id}} ${{group.status}} ${{group.confidence ?? "-"}}`;
  box.appendChild(document.createElement("p")).textContent = (group.reasons ?? []).join("; ");
  const list = box.appendChild(document.createElement("ul"));
  for (const file of group.files ?? []) list.appendChild(document.createElement("li")).textContent = file.relative_path;
  for (const decision of ["CONFIRM", "REJECT", "DEFER"]) {{
    const button = box.appendChild(document.createElement("button"));
    button.textContent = decision;
    button.onclick = () => {{ chosen.set(group.group_id, {{group_id: group.group_id, decision, preferred_file_id: null, reviewed_at: new Date().toISOString()}}); box.dataset.decision = decision; }};
  }}
}}
const save = main.appendChild(document.createElement("button"));
save.textContent = "Save decisions";
save.onclick = () => {{
  const out = {{schema_version: 1, report_id: data.report_id, catalog_revision: data.catalog_revision, generated_at: data.generated_at, decisions: [...chosen.values()]}};
  const link = document.createElement("a");
  link.href = URL.createObjectURL(new Blob([JSON.stringify(out, null, 2)], {{type: "application/json"}}));
  link.download = "decisions.json";
  link.click();
}};
</script>
"""


def _pieces(entries: DataFrame, head: dict) -> Iterator[str]:
    """The manifest with sorted keys and an indent of 2, a group at a time."""
    yield "{\n"
    for key in sorted([*head, "groups"]):
        if key != "groups":
            yield f"  {json.dumps(key)}: {json.dumps(head[key])}"
        else:
            yield '  "groups": ['
            first = True
            for row in entries.orderBy("group_id").select("entry").toLocalIterator():
                text = json.dumps(json.loads(row.entry), indent=2, sort_keys=True)
                yield ("\n" if first else ",\n") + "\n".join("    " + line for line in text.split("\n"))
                first = False
            yield "]" if first else "\n  ]"
        yield "\n" if key == max([*head, "groups"]) else ",\n"
    yield "}"


def write_review(entries: DataFrame, root: Path, report_id: str, revision: str, now: datetime) -> Path:
    """Writes manifest.json and a page that stands alone below ``root`` and returns their folder. entries: group_id, entry (JSON)."""
    folder = root / "reports" / f"duplicates-review-{now:%Y%m%d-%H%M%S}"
    folder.mkdir(parents=True, exist_ok=True)
    head = {"report_id": report_id, "catalog_revision": revision, "generated_at": now.isoformat()}
    with (folder / "manifest.json").open("w", encoding="utf-8") as out:
        out.writelines(_pieces(entries, head))
    before, after = PAGE.replace("{{", "{").replace("}}", "}").split("{manifest}")
    with (folder / "index.html").open("w", encoding="utf-8") as out, (folder / "manifest.json").open(encoding="utf-8") as manifest:
        out.write(before)
        out.writelines(line.replace("</", "<\\/") for line in manifest)
        out.write(after)
    return folder


def default_export_path(root: Path, name: str, form: str, now: datetime) -> Path:
    return root / "exports" / f"{name}-{now:%Y%m%d-%H%M%S}.{form}"


def export(rows: DataFrame, form: str, path: str, order_by: list[str]) -> None:
    """Writes a table as csv (with a header), or as json, a row a line with all fields."""
    if form == "csv":
        write_csv(rows, path, order_by)
    elif form == "json":
        rows.orderBy(*order_by).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no such form: {form!r}")
