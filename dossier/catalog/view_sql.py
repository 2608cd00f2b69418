"""SQL spelling of the domain views, used as CTEs by the SQL twins."""

from __future__ import annotations

import re

from dossier.operators.extraction import DEED_FIELDS

_FIELD_LIST = ", ".join(f"'{f}'" for f in DEED_FIELDS)

VIEW_SQL: dict[str, str] = {
    "v_users": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, lower(n_name) || '@example.org' AS email FROM nation""",
    "v_companies": """
        SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS user_id, c_name AS nombre,
               'rfc' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS rfc,
               CAST(DATE '1998-01-01' + CAST(c_custkey % 400 AS INTEGER) AS TIMESTAMP) AS created_at,
               CAST(DATE '1998-02-01' + CAST(c_custkey % 500 AS INTEGER) AS TIMESTAMP) AS updated_at
        FROM customer""",
    "v_letterheads": """
        SELECT c_custkey * 3 + k AS id, c_custkey AS company_id, c_mktsegment || ' ' || CAST(k AS VARCHAR) AS title,
               (c_custkey + k) % 3 <> 0 AS is_default,
               CAST(DATE '1998-03-01' + CAST((c_custkey + k) % 90 AS INTEGER) AS TIMESTAMP) AS created_at
        FROM customer, (VALUES (0), (1), (2)) AS t(k)""",
    "v_tenders": """
        SELECT o_orderkey AS id, o_custkey % 25 AS user_id, o_custkey AS company_id,
               CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey * 3 + o_orderkey % 3 END AS company_letterhead_id,
               'Licitacion ' || CAST(o_orderkey AS VARCHAR) AS title,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'publica' ELSE 'privada' END AS process_type,
               CASE WHEN o_orderkey % 13 = 0 THEN 'committed' WHEN o_orderkey % 11 = 0 THEN 'sent_for_approval'
                    WHEN o_orderstatus = 'O' THEN 'draft' WHEN o_orderstatus = 'P' THEN 'analyzing' ELSE 'ready' END AS status,
               CASE WHEN o_orderkey % 5 <> 0 THEN 'bases/' || CAST(o_orderkey AS VARCHAR) || '.pdf' END AS bases_document_path,
               CASE WHEN o_orderkey % 7 <> 0 THEN 'bases-' || CAST(o_orderkey AS VARCHAR) || '.pdf' END AS bases_document_original_name,
               CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 3 <> 0 END AS chk_regulations,
               o_orderkey % 5 <> 0 AS chk_bases,
               CAST(o_orderdate AS TIMESTAMP) AS created_at
        FROM orders""",
    "v_checklist": """
        SELECT id AS tender_id, 0 AS pos, 'Empresa seleccionada' AS label, TRUE AS checked FROM v_tenders
        UNION ALL SELECT id, 1, 'Regulaciones asignadas', chk_regulations FROM v_tenders
        UNION ALL SELECT id, 2, 'Bases cargadas', chk_bases FROM v_tenders""",
    "v_regulations": """
        SELECT p_partkey AS id, p_partkey % 25 AS user_id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS title,
               CASE p_size % 3 WHEN 0 THEN 'mx' WHEN 1 THEN 'US' ELSE 'Co' END AS country_code,
               CASE p_size % 4 WHEN 0 THEN 'federal' WHEN 1 THEN 'estatal' WHEN 2 THEN 'local' ELSE 'entidad' END AS scope,
               CASE WHEN p_size % 7 <> 0 THEN p_brand END AS regulatory_body,
               p_size % 5 <> 0 AS is_active,
               CASE WHEN p_partkey % 9 <> 0 THEN 'module2/' || lower(p_type) || '/' || CAST(p_partkey AS VARCHAR) || '.pdf' END AS source_pdf_path,
               CASE WHEN p_partkey % 2 = 0 THEN p_name || '.pdf' ELSE '' END AS source_pdf_original_name,
               CAST(DATE '1998-01-15' + CAST(p_partkey % 200 AS INTEGER) AS TIMESTAMP) AS created_at
        FROM part""",
    "v_bridge": "SELECT DISTINCT l_orderkey AS licitacion_id, l_partkey AS regulation_id FROM lineitem",
    "v_opinions": """
        SELECT o_custkey * 9 + (l_linenumber % 3) * 3 + instr('ARN', l_returnflag) - 1 AS id, o_custkey AS company_id,
               CASE l_linenumber % 3 WHEN 0 THEN 'sat' WHEN 1 THEN 'infonavit' ELSE 'imss' END AS tipo,
               CASE l_returnflag WHEN 'A' THEN 'positivo' WHEN 'R' THEN 'negativo' ELSE 'pendiente' END AS estado,
               CAST(max(l_shipdate) AS DATE) AS fecha_emision,
               CASE WHEN count(*) % 3 <> 0 THEN CAST(max(l_shipdate) AS DATE) + CAST(count(*) % 45 AS INTEGER) END AS fecha_vigencia
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY o_custkey, l_linenumber % 3, l_returnflag""",
    "v_deeds": """
        SELECT doc_id AS id, doc_id // 2 AS company_id,
               CASE doc_id % 3 WHEN 0 THEN 'constitutiva' WHEN 1 THEN 'modificacion' ELSE 'poderes' END AS tipo,
               DATE '1997-01-01' + CAST(doc_id % 700 AS INTEGER) AS fecha_registro,
               CASE WHEN doc_id % 10 <> 9 THEN 'actas/' || CAST(doc_id AS VARCHAR) || '.pdf' END AS documento_path,
               CAST(DATE '1998-06-01' + CAST(doc_id % 60 AS INTEGER) AS TIMESTAMP) AS created_at,
               CAST(DATE '1998-06-02' + CAST(doc_id % 90 AS INTEGER) AS TIMESTAMP) AS updated_at
        FROM documents""",
    "v_statements": """
        SELECT o_orderkey AS id, o_custkey AS company_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'mensual' WHEN 1 THEN 'anual' ELSE 'otro' END AS periodicity,
               1995 + o_orderkey % 110 AS year, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 14 END AS month,
               CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 2 = 0 END AS is_audited,
               'estado-' || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 9 = 0 THEN '.doc' ELSE '.pdf' END AS file_name,
               o_orderkey % 25000 AS file_kb
        FROM orders WHERE o_orderstatus = 'F'""",
    "v_declarations": """
        SELECT o_orderkey AS id, o_custkey AS company_id,
               CASE o_orderkey % 2 WHEN 0 THEN 'mensual' ELSE 'anual' END AS periodicity,
               1995 + o_orderkey % 10 AS year, CASE WHEN o_orderkey % 6 <> 0 THEN 1 + o_orderkey % 12 END AS month,
               'decl.' || CAST(o_orderkey AS VARCHAR) ||
                 (['.pdf', '.XML', '.xlsx', '.Xls', '.csv', '.docx', ''])[CAST(o_orderkey % 7 AS INTEGER) + 1] AS file_name
        FROM orders WHERE o_orderstatus = 'P'""",
    "v_validations": """
        SELECT o_orderkey + 1000000 AS id, o_custkey % 25 AS user_id, o_orderkey AS licitacion_id,
               CASE WHEN o_orderstatus = 'F' THEN 'ready_for_export' WHEN o_orderpriority = '5-LOW' THEN 'draft' ELSE 'reviewed' END AS status,
               CASE o_orderkey % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'red' END AS traffic_light,
               o_orderkey % 10 = 0 AS override_applied,
               CASE WHEN o_orderkey % 10 = 0 THEN 'motivo legal ' || CAST(o_orderkey AS VARCHAR) END AS override_reason,
               CAST(o_orderdate AS TIMESTAMP) AS created_at
        FROM orders WHERE o_orderstatus <> 'O'""",
    "v_findings": """
        SELECT l_orderkey * 100 + instr('ARN', l_returnflag) * 10 + l_linenumber AS id,
               l_orderkey + 1000000 AS proposal_validation_id,
               CASE l_returnflag WHEN 'A' THEN 'critical' WHEN 'R' THEN 'warning' ELSE 'info' END AS severity,
               CASE WHEN l_returnflag = 'A' THEN 'cumplimiento' ELSE 'seguimiento' END AS category,
               'R-' || CAST(l_linenumber AS VARCHAR) AS rule_code,
               'Hallazgo x' || CAST(count(*) AS VARCHAR) AS message,
               CASE WHEN l_linenumber % 2 = 0 THEN 'Nota ' || CAST(l_linenumber AS VARCHAR) END AS resolution_note
        FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey, l_returnflag, l_linenumber""",
    "v_report_rows": """
        SELECT l_orderkey + 1000000 AS validation_id,
               CASE WHEN l_orderkey % 3 = 0 THEN 'structured' WHEN l_linenumber % 2 = 0 THEN 'issue' ELSE 'warning' END AS kind,
               CAST(l_linenumber AS BIGINT) AS pos,
               CASE WHEN l_linenumber % 3 <> 0 THEN 'Cumplimiento general' END AS documento,
               CASE WHEN l_linenumber % 4 <> 0 THEN 'Alta' END AS gravedad,
               'mensaje ' || CAST(l_linenumber AS VARCHAR) || ' x' || CAST(count(*) AS VARCHAR) AS error,
               CASE WHEN l_linenumber % 5 <> 0 THEN 'Corregir' END AS propuesta_solucion
        FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey, l_linenumber""",
    "v_document_index": """
        SELECT doc_id AS id, (['acta', 'opinion', 'regulation'])[CAST(doc_id % 3 AS INTEGER) + 1] AS document_type,
               (['Acta', 'OpinionCumplimiento', 'Regulation'])[CAST(doc_id % 3 AS INTEGER) + 1] AS documentable_type,
               doc_id // 3 AS documentable_id, doc_id % 25 AS user_id,
               (['pending', 'processed', 'indexed', 'failed', 'processed'])[CAST(doc_id % 5 AS INTEGER) + 1] AS status,
               'files/' || CAST(doc_id AS VARCHAR) || '.pdf' AS storage_path,
               CASE WHEN doc_id % 8 = 0 THEN 'error de texto' END AS error_message,
               TIMESTAMP '1998-06-28 00:00:00' + to_hours(CAST(doc_id % 72 AS INTEGER)) AS created_at,
               TIMESTAMP '1998-06-28 12:00:00' + to_hours(CAST(doc_id % 96 AS INTEGER)) AS updated_at,
               CASE WHEN doc_id % 5 NOT IN (0, 3) THEN text END AS extracted_text,
               CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 NOT IN (0, 3) THEN text END AS index_text
        FROM documents""",
    "v_audit_events": """
        SELECT event_id AS id, CASE WHEN event_id % 19 <> 0 THEN user_id % 25 END AS user_id,
               'http.' || event_type AS event_type,
               (['Acta', 'Regulation', 'Licitacion'])[CAST(event_id % 3 AS INTEGER) + 1] AS entity_type,
               user_id AS entity_id,
               (['GET', 'POST', 'PUT', 'DELETE', 'HEAD', 'OPTIONS'])[CAST(event_id % 6 AS INTEGER) + 1] AS request_method,
               200 + event_id % 4 * 100 AS status_code,
               CASE WHEN event_id % 2 = 0 THEN ['title', '_token', 'password'] ELSE ['k', 'current_password'] END AS payload_keys,
               props AS metadata, CAST(ts AS TIMESTAMP) AS created_at
        FROM events""",
    "v_transition_requests": """
        SELECT CASE WHEN event_id % 29 = 0 THEN 'contract' WHEN event_id % 3 = 0 THEN 'validation' ELSE 'tender' END AS entity_type,
               user_id AS entity_id, event_id AS seq,
               CASE WHEN event_id % 3 = 0
                    THEN CASE event_type WHEN 'view' THEN 'reviewed' WHEN 'click' THEN 'ready_for_export' WHEN 'error' THEN 'draft' ELSE 'archived' END
                    ELSE CASE WHEN event_type = 'view' THEN 'analyzing' WHEN event_type = 'click' THEN 'ready' WHEN event_type = 'signup' THEN 'draft'
                              WHEN event_type = 'purchase' THEN 'sent_for_approval' WHEN value < 20 THEN 'committed' ELSE 'draft' END END AS to_state,
               user_id, 'evento ' || event_type AS reason
        FROM events""",
    "v_pages": """
        SELECT conv_id AS doc_id, turn + 1 AS page_number,
               'ESCRITURA N~MERO ' || CAST(conv_id * 7 + turn AS VARCHAR) || ' LIBRO ' || CAST(turn + 1 AS VARCHAR) || chr(13) || chr(10) ||
               '  Constituci~n de la sociedad - -- -  ' || chr(10) ||
               'inscripci~n -- -- en el Registro P~blico' || chr(9) || 'de  comercio' || chr(13) ||
               chr(10) || chr(10) || chr(10) || '~~~ === ~~~' || chr(10) ||
               CASE WHEN turn % 3 = 0 THEN '. - .' WHEN turn % 3 = 1 THEN 'a1 ++ -- ##' ELSE 'FOLIO MERCANTIL 12 NOTARIO' END || chr(10) ||
               '   ' || chr(10) || text || ' —— -' || chr(10) || chr(10) || '1 2 ** !!' || chr(10) || 'x' || chr(10) || text || chr(10) || chr(10) AS text
        FROM conversations""",
    "v_page_variants": """
        SELECT conv_id AS doc_id, turn + 1 AS page_number, CAST(v AS BIGINT) AS variant,
               CASE v WHEN 0 THEN CASE WHEN turn % 2 = 0 THEN text ELSE reverse(text) END
                      WHEN 1 THEN 'ESCRITURA NOTARIA 12 LIBRO 3' || chr(10) || lower(text) || ' Folio'
                      ELSE 'folio mercantil ' || text || ' FECHA 12' END AS text
        FROM conversations, (VALUES (0), (1), (2)) AS t(v)""",
    "v_deed_texts": """
        SELECT doc_id, (['acta', 'acta', 'opinion', 'regulation', 'otro'])[CAST(doc_id % 5 AS INTEGER) + 1] AS document_type,
               CASE WHEN doc_id % 9 = 0 THEN '' ELSE
                 'ESCRITURA NÚMERO: ' || CAST(doc_id * 3 + 100 AS VARCHAR) || '/' || CAST(1990 + doc_id % 30 AS VARCHAR) || chr(10) ||
                 CASE WHEN doc_id % 4 = 0 THEN 'Notaria No. 7;' ELSE 'NOTARÍA NÚMERO: ' || CAST(doc_id % 150 + 1 AS VARCHAR) || ';' END || chr(10) ||
                 'Notaría de Monterrey Nuevo León; 64000' || chr(10) ||
                 'Notario Público: Lic. Ana Pérez Núñez; 12' || chr(10) ||
                 'Folio Mercantil: ' || CAST(doc_id AS VARCHAR) || '-' || CASE WHEN doc_id % 2 = 0 THEN '1*' ELSE 'A' END || chr(10) ||
                 'Registro Público de Comercio de Guadalajara Jalisco; ' ||
                 'Fecha de inscripción: ' || CAST(doc_id % 31 + 1 AS VARCHAR) || '/' || CAST(doc_id % 12 + 1 AS VARCHAR) || '/' || CAST(2000 + doc_id % 24 AS VARCHAR) || chr(10) ||
                 'Fecha de registro: ' || CAST(doc_id % 28 + 1 AS VARCHAR) || '-' || CAST(doc_id % 12 + 1 AS VARCHAR) || '-' ||
                 CASE WHEN doc_id % 3 = 0 THEN lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') ELSE CAST(1999 + doc_id % 20 AS VARCHAR) END || chr(10) ||
                 'Acto: ' || CASE WHEN doc_id % 3 = 0 THEN 'Constitución de sociedad,' WHEN doc_id % 3 = 1 THEN 'n/a'
                                  ELSE 'reforma de estatutos; otorgamiento de poderes.' END || ' 9' || chr(10) ||
                 'Opinión ' || CASE WHEN doc_id % 2 = 0 THEN 'positiva' ELSE 'NEGATIVA' END || CASE WHEN doc_id % 7 = 0 THEN ' INFONAVIT' WHEN doc_id % 7 = 1 THEN ' imss' ELSE '' END || chr(10) ||
                 'Fecha de emisión: 0' || CAST(doc_id % 9 + 1 AS VARCHAR) || '/05/1998 Vigencia: 3' || CAST(doc_id % 2 AS VARCHAR) || '/06/1998' || chr(10) ||
                 'Secretaría de Economía; 1' || chr(10) END || text AS text
        FROM documents""",
    "v_candidates": f"""
        SELECT doc_id, source_key, CASE WHEN s = 3 THEN 'vision_first' ELSE source_key END AS source, CAST(s + 1 AS BIGINT) AS stage_order, field,
               CASE WHEN field IN ('apoderados', 'participacion_accionaria', 'consejo_administracion', 'direccion_empresa') OR h = 0 THEN NULL
                    WHEN h = 1 THEN 'n/a' WHEN h = 2 THEN ' ' WHEN h = 3 THEN '7b'
                    WHEN field IN ('fecha_registro', 'rpc_fecha_inscripcion', 'fecha_inscripcion') THEN '2024-0' || CAST(h - 3 AS VARCHAR) || '-11'
                    ELSE 'Valor ' || CAST(h % 4 AS VARCHAR) END AS value,
               CASE WHEN h >= 4 AND field = 'apoderados' THEN '[{{"ine":"1","poder_documento":null,"nombre_completo":"Ana","facultades_otorgadas":"n/a"}}]'
                    WHEN h >= 5 AND field = 'participacion_accionaria' THEN '[{{"socio":"Eva","porcentaje":"50%"}}]'
                    WHEN h >= 6 AND field IN ('consejo_administracion', 'direccion_empresa') THEN '["Ana","Eva"]'
                    WHEN field IN ('apoderados', 'participacion_accionaria', 'consejo_administracion', 'direccion_empresa') THEN '[]' END AS value_json,
               CAST(CASE WHEN s = 3 THEN 2 END AS BIGINT) AS page_number
        FROM (SELECT doc_id, s, (['llm', 'llm_retry', 'vision', 'vision_first_page_2'])[s + 1] AS source_key, ([{_FIELD_LIST}])[f + 1] AS field,
                     (doc_id * 31 + s * 7 + f * 13) % 11 AS h
              FROM documents, (SELECT unnest(range(4)) AS s), (SELECT unnest(range(15)) AS f))""",
    "v_decisions": """
        SELECT doc_id, field, (['llm', 'vision', 'desconocida'])[CAST((doc_id + length(field)) % 3 AS INTEGER) + 1] AS source_key, 'revision manual' AS reason
        FROM documents, (VALUES ('acto'), ('libro_numero'), ('rpc_folio')) AS t(field)""",
    "v_vectors": """
        SELECT 'documents-' || document_type AS namespace, document_type || '-' || CAST(label AS VARCHAR) || '-' || CAST(vec_id AS VARCHAR) AS id,
               CAST(label AS BIGINT) AS doc_id, document_type, vec_id AS chunk_index, embedding AS values,
               CASE WHEN vec_id % 10 = 0 THEN ' ' WHEN vec_id % 10 = 1 THEN 'Resumen estructurado del acta x'
                    ELSE 'fragmento ' || CAST(vec_id % 37 AS VARCHAR) END AS text
        FROM (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 'opinion' ELSE 'acta' END AS document_type FROM embeddings)""",
}


def register_view(name: str, sql: str) -> None:
    VIEW_SQL[name] = sql


def _uses(sql: str) -> list[str]:
    return [name for name in VIEW_SQL if re.search(rf"\b{name}\b", sql)]


def with_views(body: str) -> str:
    """Prefix ``body`` with a WITH clause holding every view it names, dependencies first."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in _uses(sql):
            if name not in ordered:
                visit(VIEW_SQL[name])
                ordered.append(name)

    visit(body)
    if not ordered:
        return body
    head = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in ordered)
    stripped = body.strip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {head},\n{stripped[5:]}"
    return f"WITH {head}\n{stripped}"
