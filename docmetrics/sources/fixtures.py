"""Two small parsed reports (markdown) that carry metric text and tables.

The driver's ``documents`` hold invented European-language prose without
tables or metric figures; the corpus queries add these two reports to it so
the table and extraction paths see real rows. The SQL oracle carries the same
two rows as VALUES.
"""

from __future__ import annotations

# --- Fixed values: report texts (test inputs) -------------------------------------
REPORT_A = (
    "# 永續報告書 2023\n"
    "\n"
    "## 環境指標\n"
    "溫室氣體排放量：12,345 公噸CO2e\n"
    "用水量：45,678 立方米\n"
    "\n"
    "## 社會指標\n"
    "員工培訓時數：42.5 小時/人\n"
    "整體薪酬水準：85.6%\n"
    "\n"
    "| 指標 | 數值 |\n"
    "| --- | --- |\n"
    "| 溫室氣體排放量 | 12,345 公噸CO2e |\n"
    "| 員工培訓時數 | 42.5 小時/人 |\n"
)

REPORT_B = (
    "# ESG 報告測試文件\n"
    "\n"
    "## 環境指標\n"
    "2023年溫室氣體排放量為12,345公噸CO2e，相較2022年減少5%。\n"
    "\n"
    "## 社會指標\n"
    "員工人數達到500人，女性主管比例為35%。\n"
    "員工平均training時數為42小時/年。\n"
    "\n"
    "| 指標 | 數值 |\n"
    "| --- | --- |\n"
    "| 能源使用量 | 1,234,567 kWh |\n"
    "| 工傷率 | 0.5% |\n"
)

REPORTS = (("A", "test_doc.docx", ".docx", REPORT_A),
           ("B", "test_esg_report.docx", ".docx", REPORT_B))
# ----------------------------------------------------------------------------------


def sql_values() -> str:
    """The two reports as a SQL VALUES list (document_id, text)."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({q(d)}, {q(t)})" for d, _, _, t in REPORTS)
