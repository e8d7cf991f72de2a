"""Declared schemas (DDL) of the stored tables and interchange records."""

DOC_TYPES = ("annual_report", "concall", "announcement")

COMPANY = "symbol string, name string, isin string, industry string"

DOCUMENT = (
    "id string, symbol string, doc_type string, period string, source_url string, "
    "storage_path string, sha256 string, nse_seq_id bigint, ingested_at timestamp"
)

PAGE = "document_id string, page int, text string"

CHUNK = (
    "id string, document_id string, page int, section string, content string, token_count int"
)

STORED_CHUNK = (
    "id string, document_id string, page int, section string, content string, "
    "token_count int, embedding array<float>, embedding_provider string"
)

BLOCK = (
    "document_id string, page int, page_width double, page_height double, "
    "x0 double, y0 double, x1 double, y1 double, text string"
)

ANNOUNCEMENT_COLUMNS = ("symbol", "desc", "attchmntText", "attchmntFile", "an_dt", "seq_id")
ANNOUNCEMENT = ", ".join(f"{c} string" for c in ANNOUNCEMENT_COLUMNS)

ANNUAL_REPORT = (
    "symbol string, fromYr string, toYr string, fileName string, attFileSize string"
)

ANSWER_EVENT = (
    "request_id string, seq bigint, type string, sources array<struct<content:string,"
    "symbol:string,doc_type:string,period:string,page:int,source_url:string,score:double>>, "
    "text string, refused boolean, error string"
)

PROBE = (
    "environment struct<label:string,hostname:string,platform:string,egress_ip:string,"
    "measured_at:string>, "
    "announcements_probe struct<status:int,error:string,row_count:bigint>, "
    "pdf_downloads array<struct<url:string,status:int,bytes:bigint,elapsed_ms:double,"
    "content_type:string,error:string>>"
)

SEED_PROBE = (
    "symbols map<string,struct<probe:struct<status:int,error:string,row_count:bigint>,"
    "matches:array<struct<symbol:string,desc:string,attchmntText:string,"
    "attchmntFile:string,an_dt:string,seq_id:string>>>>"
)
