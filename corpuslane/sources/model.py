"""Schemas of the entities and a reader of table definitions."""

from __future__ import annotations

import re

from pyspark.sql.types import StructType

_TYPES = {"int": "int", "integer": "int", "bigint": "bigint", "smallint": "smallint", "serial": "bigint", "varchar": "string", "char": "string", "character": "string", "text": "string", "boolean": "boolean", "bool": "boolean", "double": "double", "real": "float", "float": "double", "numeric": "decimal(18,2)", "decimal": "decimal(18,2)", "timestamp": "timestamp", "date": "date"}
PARTIAL_DATE = "struct<year:int,month:int,day:int,hour:int,minute:int,second:int>"
_BASE = "id bigint, module string, credibility int"
_BODY = {
    "project_type": "type string",
    "organization": "title string, acronym string, type_id bigint, parent_id bigint, title_normalized string, location_id bigint",
    "event_series": f"frequency bigint, last_occurence {PARTIAL_DATE}, title string",
    "location_type": "type string",
    "person_name": "first_name string, last_name string, middle_name string, full_name string, original string",
    "module": "module_name string",
    "tag": "title string",
    "project": f"status string, duration_months bigint, funding bigint, title string, acronym string, type_id bigint, currency string, organization_grants_id bigint, cost double, start_date {PARTIAL_DATE}, annotation string, ref_code string",
    "location": "city string, name string, type_id bigint, country string, address string, woeid bigint",
    "contact": "telephone string, fax string, email struct<localpart:string,domain:string>",
    "citation": "text_position_to bigint, publication_id bigint, text_position_from bigint, content string, reference_page_to bigint, reference_page_count bigint, reference_page_from bigint, reference_id bigint",
    "organization_type": "type string",
    "network": "name string",
    "url_type": "type string",
    "publication": "issn string, isbn string, type_id bigint, abstract string, number bigint, text_position_from bigint, month bigint, year bigint, presentation_id bigint, event_id bigint, joint_authors boolean, language_id bigint, note string, parent_id bigint, publisher_id bigint, text_position_to bigint, acronym string, volume bigint, title_normalized string, pages string, text_id bigint, series_id bigint, doi string, title string, submitted boolean, to_appear boolean",
    "text": "content string, length bigint, file_id bigint",
    "presentation": "event_id bigint, title string",
    "event_type": "type string",
    "file": "importname string, hash string, filename string, type string, size bigint",
    "keyword": "title string",
    "award": "name string",
    "event_name": "event_id bigint, acronym string, title string",
    "geoplanet": "admin1 bigint, woeid bigint, admin2 bigint, name string, country string",
    "publication_type": "type string",
    "topic": "parent_id bigint, title string",
    "rank": "url_id bigint, year bigint, name string",
    "publication_series": f"frequency bigint, last_occurence {PARTIAL_DATE}, title string",
    "person": "first_name string, last_name string, middle_name string, full_name_ascii string, sex string, full_name_national string, full_name string, original string",
    "reference": "publication_id bigint, content string, source_url_id bigint, referenced_publication_id bigint",
    "publication_section": "title string, publication_id bigint, text_position_to bigint, number bigint, text_position_from bigint, parent_id bigint, text_id bigint",
    "event": f"start_timestamp {PARTIAL_DATE}, title string, acronym string, type_id bigint, series_id bigint, parent_id bigint, title_normalized string, location_id bigint, sequence_number bigint, end_timestamp {PARTIAL_DATE}",
    "url": "available boolean, title string, type_id bigint, link string, file_id bigint",
    "organization_name": "acronym string, organization_id bigint, title string",
    "language": "name string",
}
ENTITIES = {name: f"{_BASE}, {body}" for name, body in _BODY.items()}
#: Provenance of an entity, one append-only row a change.
META = "entity_id bigint, module_id bigint, credibility int, changed timestamp"


def parse_ddl(text: str) -> dict[str, StructType]:
    """CREATE TABLE statements as schemas by table name; constraints and keys are passed over."""
    out = {}
    for m in re.finditer(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)\s*\((.*?)\)\s*;", text, re.I | re.S):
        fields = []
        for line in re.split(r",(?![^(]*\))", m[2]):
            c = re.match(r"\s*\"?(\w+)\"?\s+([A-Za-z]+)", line)
            if c and c[1].lower() not in ("constraint", "primary", "foreign", "unique", "check") and c[2].lower() in _TYPES:
                fields.append(f"`{c[1].lower()}` {_TYPES[c[2].lower()]}{' NOT NULL' if re.search(r'not\s+null', line, re.I) else ''}")
        out[m[1].split(".")[-1].strip('"').lower()] = StructType.fromDDL(", ".join(fields))
    return out
