"""Table schemas, value domains and seed rows of the matter data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, FloatType, IntegerType, LongType, StringType, StructType, TimestampType

_TYPES: dict[str, DataType] = {"string": StringType(), "timestamp": TimestampType(), "date": DateType(), "int": IntegerType(), "long": LongType(), "boolean": BooleanType(), "array<float>": ArrayType(FloatType())}

#: Tables and their columns, as stored.
_DDL = {
    "profiles": "id string not null, email string not null, full_name string, created_at timestamp not null, updated_at timestamp not null",
    "user_roles": "id string not null, user_id string not null, role string not null, created_at timestamp not null",
    "clients": "id string not null, name string not null, description string, created_by string, created_at timestamp not null, updated_at timestamp not null",
    "matters": "id string not null, client_id string, name string not null, sector string, matter_type string, status string not null, lead_partner_id string, opened_date date not null, target_close_date date, description string, created_by string, created_at timestamp not null, updated_at timestamp not null",
    "matter_stages": "id string not null, matter_id string not null, name string not null, sort_order int not null, status string not null, completed_at timestamp, created_at timestamp not null",
    "matter_parties": "id string not null, matter_id string not null, name string not null, role string not null, contact_info string, created_at timestamp not null",
    "document_types": "id string not null, name string not null, category string not null, required_fields string not null, typical_stage string, created_at timestamp not null, updated_at timestamp not null",
    "matter_documents": "id string not null, matter_id string not null, document_type_id string, title string not null, status string not null, owner_id string, created_by string, created_at timestamp not null, updated_at timestamp not null",
    "document_versions": "id string not null, matter_document_id string not null, version_number int not null, storage_path string not null, is_ai_generated boolean not null, uploaded_by string, created_at timestamp not null",
    "documents": "id string not null, content string not null, embedding array<float>, metadata string not null, matter_id string, document_type_id string, is_precedent boolean not null, created_by string, created_at timestamp not null, updated_at timestamp not null",
    "redline_suggestions": "id string not null, document_version_id string not null, clause_reference string, original_text string, suggested_text string, rationale string, status string not null, created_at timestamp not null",
    "matter_notes": "id string not null, matter_id string not null, author_id string, content string not null, created_at timestamp not null",
    "matter_tasks": "id string not null, matter_id string not null, title string not null, assignee_id string, due_date date, status string not null, created_by string, created_at timestamp not null, updated_at timestamp not null",
    "ai_chat_threads": "id string not null, matter_id string, title string, created_by string, created_at timestamp not null",
    "ai_chat_messages": "id string not null, thread_id string not null, role string not null, content string not null, created_at timestamp not null",
    "support_requests": "id string not null, user_id string, subject string not null, message string not null, status string not null, created_at timestamp not null",
}


def _struct(ddl: str) -> StructType:
    """A schema from a list of columns; needs no session."""
    out = StructType()
    for column in ddl.split(", "):
        name, kind, *rest = column.split(" ")
        out.add(name, _TYPES[kind], not rest)
    return out


TABLES: dict[str, StructType] = {name: _struct(ddl) for name, ddl in _DDL.items()}

CHUNK_METADATA = _struct("filename string, file_type string, upload_date string, storage_path string, storage_bucket string, file_size long, original_format string, page_count int, sheet_count int, chunk_index int, chunk_total int")

#: The domains of the closed status and role columns, in their order.
DOMAINS = {
    ("user_roles", "role"): ("admin", "partner", "associate", "paralegal"),
    ("matter_documents", "status"): ("not_started", "drafting", "internal_review", "with_counterparty", "negotiation", "finalized", "executed"),
    ("redline_suggestions", "status"): ("pending", "accepted", "rejected"),
    ("matter_tasks", "status"): ("open", "in_progress", "done"),
}

#: Columns whose values must be unique together, beside each table's id.
UNIQUE = {"user_roles": ("user_id", "role"), "document_types": ("name",), "document_versions": ("matter_document_id", "version_number")}

#: Child table -> (column, parent table, what a parent's deletion does)
FOREIGN_KEYS = {
    "matters": [("client_id", "clients", "set null")],
    "matter_stages": [("matter_id", "matters", "cascade")],
    "matter_parties": [("matter_id", "matters", "cascade")],
    "matter_documents": [("matter_id", "matters", "cascade")],
    "document_versions": [("matter_document_id", "matter_documents", "cascade")],
    "documents": [("matter_id", "matters", "cascade")],
    "redline_suggestions": [("document_version_id", "document_versions", "cascade")],
    "matter_notes": [("matter_id", "matters", "cascade")],
    "matter_tasks": [("matter_id", "matters", "cascade")],
    "ai_chat_threads": [("matter_id", "matters", "cascade")],
    "ai_chat_messages": [("thread_id", "ai_chat_threads", "cascade")],
}

#: Tables whose rows carry an updated_at that every update refreshes.
TOUCHED = ("profiles", "clients", "matters", "document_types", "matter_documents", "documents", "matter_tasks")

#: The document types a new store starts with.
DOCUMENT_TYPES = (
    ("Concession Agreement", "Project & Concession"),
    ("Concession Direct Agreement", "Project & Concession"),
    ("Site License Agreement", "Project & Concession"),
    ("EPC Contract", "Construction & Engineering"),
    ("Independent Engineer's Agreement", "Construction & Engineering"),
    ("Design Agreement", "Construction & Engineering"),
    ("Common Terms Agreement (CTA)", "Financing & Security"),
    ("Interfinance Agreement", "Financing & Security"),
    ("Islamic Finance Agreement", "Financing & Security"),
    ("Intercreditor Agreement", "Financing & Security"),
    ("Escrow Agreement", "Financing & Security"),
    ("Equity and Funding Utilization Agreement", "Equity & Commercial"),
    ("Price Escalation Agreement", "Equity & Commercial"),
    ("Independent Auditors' Agreement", "Assurance"),
)

#: The stages of a new matter, in order, and the private file buckets.
DEFAULT_STAGES = ("Origination", "Due Diligence", "Drafting", "Negotiation", "Financial Close", "Post-Closing")
BUCKETS = ("matter-documents", "precedent-library")


def in_domain(table: str, column: str) -> Column:
    """True where the column holds a value of its domain; null stays null."""
    return F.col(column).isin(*DOMAINS[table, column])


def seed_document_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DOCUMENT_TYPES), "name string, category string")
