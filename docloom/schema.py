"""Fixed dimensions of the document model and the layouts of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Section ids in catalog order, with their Arabic and English names.
SECTIONS = (
    ("SEC01", "ترويسة دائرة السياسات والاجراءات", "Department Header / Banner"),
    ("SEC02", "ترويسة الوثيقة", "Document Header"),
    ("SEC03", "ضبط الوثيقة", "Document Control"),
    ("SEC04", "إقرار الوثيقة", "Document Approval"),
    ("SEC05", "ضبط الإصدار", "Version Control"),
    ("SEC06", "جدول / قائمة المحتويات", "Table of Contents"),
    ("SEC07", "الهدف من الوثيقة", "Purpose"),
    ("SEC08", "مجال التطبيق", "Scope"),
    ("SEC09", "المسؤوليات", "Responsibilities"),
    ("SEC10", "المراجع الرئيسية", "Key References"),
    ("SEC11", "التعليمات العامة", "General Instructions"),
    ("SEC12", "الإجراء", "Procedures / Workflow Steps"),
    ("SEC13", "الإجراءات الرقابية", "Control Procedures"),
    ("SEC14", "التقارير والكشوفات", "Reports & Statements"),
    ("SEC15", "الملفات ومدد الحفظ", "Files & Retention Periods"),
    ("SEC16", "الملاحق", "Appendices"),
    ("SEC17", "النماذج المستخدمة", "Forms Used"),
    ("SEC18", "التعريفات والمختصرات والمصطلحات", "Definitions / Terms / Abbreviations"),
    ("SEC19", "النماذج", "Forms / Templates"),
    ("SEC99", "أخرى", "Other / Unclassified"),
)
SECTION_IDS = tuple(x[0] for x in SECTIONS)
OTHER = "SEC99"
#: Sections that are not turned into JSON, and not exported for retrieval.
UNPROCESSED = ("SEC01", "SEC06")
#: The column headings that a section's table has, one row for each known order.
HEADERS = (
    ("SEC03", ("اسم الوثيقة", "نوعها", "الدائرة / الوحدة")),
    ("SEC04", ("الاعداد", "المراجعة")),
    ("SEC04", ("الاعداد", "المراجعة", "الموافقة")),
    ("SEC05", ("رقم الاصدار", "تاريخه", "تم الاعداد / التعديل من قبل", "اسباب التعديل")),
    ("SEC12", ("الخطوات", "المكلف بالتنفيذ")),
    ("SEC13", ("الخطوات", "المكلف بالتنفيذ")),
    ("SEC15", ("الفئة", "اسم الملف")),
)
#: Names of sections in file names; others are made of the English name.
FILE_PREFIXES = {
    "SEC02": "document_header",
    "SEC03": "document_control",
    "SEC04": "document_approval",
    "SEC05": "version_control",
    "SEC07": "purpose",
    "SEC08": "scope",
    "SEC09": "responsibilities",
    "SEC10": "key_references",
    "SEC11": "general_instruction",
    "SEC12": "procedure",
    "SEC13": "control_procedure",
    "SEC14": "reports_statements",
    "SEC15": "files_retention_periods",
    "SEC16": "appendices",
    "SEC17": "forms_used",
    "SEC18": "definitions_terms_abbreviations",
    "SEC19": "forms_templates",
    "SEC99": "other",
}
#: Levels of the headings of a workflow.
WORKFLOW_LEVELS = {"group_header": 1, "subgroup_header": 2, "sub_subgroup_header": 3, "subsubgroup_header": 3}
#: Fills of a workflow's main headings.
GROUP_FILLS = ("#222A35", "#233744", "#243744", "#253744")

CHUNKS = "doc_id string, chunk_index int, chunk_type string, content string, table_id string, file_name string"
TABLES = (
    "doc_id string, table_id string, table_index int, location string, row_count int, column_count int, rendered_table string, chunk_type string, "
    "is_nested boolean, parent_table_id string, parent_cell_id string, chunk_file_name string"
)
CELLS = "doc_id string, cell_id string, table_id string, row int, col int, rowspan int, colspan int, text string, color string, nested_table_ids array<string>, display_text string"
ASSETS = "doc_id string, asset_id string, kind string, display_name string, original_name string, stored_name string, source_path string, content_type string, relationship_type string, content binary"
HITS = "document_id string, document_name string, chunk_id string, file_name string, section_id string, chunk_type string, hierarchy_path string, text string"


def section_dim(spark: SparkSession) -> DataFrame:
    """(ord, section_id, arabic, english): 20 rows."""
    return spark.createDataFrame([(i, *x) for i, x in enumerate(SECTIONS)], "ord int, section_id string, arabic string, english string")


def header_dim(spark: SparkSession) -> DataFrame:
    """(section_id, order_no, labels): the known heading orders."""
    return spark.createDataFrame([(s, i, list(x)) for i, (s, x) in enumerate(HEADERS)], "section_id string, order_no int, labels array<string>")
