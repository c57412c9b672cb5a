import glob
import json

from tests.test_operators import make
from wardenflow.plans import reports as R


def test_reports_and_worklists_are_whole(spark, tmp_path):
    rows = [{"tool": "t", "category": "sast", "title": f"<{i}>", "severity": ("low", "high")[i % 2], "file": f"f{i}", "line": 1, "message": "m", "status": "confirmed"} for i in range(1200)]
    rows += [{"tool": "t", "category": "sast", "title": f"open {i}", "severity": "low", "file": f"g{i}", "line": 1, "message": "m", "status": "open"} for i in range(700)]
    findings = make(spark, rows)
    text = R.report(findings)
    assert text.startswith("# Report\n\n## ") and "## confirmed (1200)" in text and "## open (700)" in text and text.count("- **") == 1900
    part = text.split("## confirmed (1200)")[1].split("## ")[0]
    assert part.count("- **high**") == part.count("- **low**") == 600 and part.rindex("**high**") < part.index("**low**")
    page = R.html_report(findings)
    assert page.startswith("<!doctype") and page.endswith("</table>") and page.count("<tr>") == 1901 and page.count("&lt;") == 1200
    listed = json.loads(R.worklist(findings))
    assert len(listed) >= 700 and len({x["id"] for x in listed}) == len(listed)
    assert "... and 1875 more" in R.summary(findings) and "more" not in R.summary(findings.limit(20))

    def written(name, write):
        write(findings, str(tmp_path / name))
        return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(str(tmp_path / name / "part-*"))))

    assert written("report", R.write_report) == text
    assert written("html", R.write_html).replace("\n", "") == page
    assert [json.loads(x) for x in written("work", R.write_worklist).splitlines()] == listed
