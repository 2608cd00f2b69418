"""Domain views derived from the driver's tables.

The given tables hold no deeds or tenders, so each business table is derived from them by fixed expressions over the
whole table. The same expressions are spelled out in SQL in ``dossier.catalog.view_sql``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.extraction import DEED_FIELDS

AS_OF = "1998-06-30"
EVENTS_AS_OF = "2024-01-30"
#: Documents whose rows of fields meet in one task; sixty rows come from each.
PART_DOCUMENTS = 5000
#: Order lines that meet in one task, by order.
PART_LINES = 500_000


class Views:
    """Lazily built views for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def parts(self) -> int:
        """Parts that documents are dealt over, so that a task holds the same number of them whatever their total."""
        return 1 + self.table("documents").count() // PART_DOCUMENTS

    def dealt_documents(self) -> DataFrame:
        """Document ids by parts, for tables that hold many rows of each document; these need no exchange by document any more.

        Ids look small to the planner: a join of what is made of them needs the ``merge`` hint, or it may be broadcast.
        """
        return self.table("documents").select("doc_id").repartition(self.parts, "doc_id")

    def users(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "cast(n_nationkey as bigint) as id", "n_name as name", "concat(lower(n_name), '@example.org') as email"
        )

    def companies(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey as id",
            "cast(c_nationkey as bigint) as user_id",
            "c_name as nombre",
            "concat('rfc', lpad(cast(c_custkey as string), 10, '0')) as rfc",
            "cast(date_add(date'1998-01-01', cast(c_custkey % 400 as int)) as timestamp) as created_at",
            "cast(date_add(date'1998-02-01', cast(c_custkey % 500 as int)) as timestamp) as updated_at",
        )

    def letterheads(self) -> DataFrame:
        copies = self.table("customer").selectExpr(
            "c_custkey", "c_mktsegment", "explode(array(0L, 1L, 2L)) as k"
        )
        return copies.selectExpr(
            "c_custkey * 3 + k as id",
            "c_custkey as company_id",
            "concat(c_mktsegment, ' ', cast(k as string)) as title",
            "(c_custkey + k) % 3 <> 0 as is_default",
            "cast(date_add(date'1998-03-01', cast((c_custkey + k) % 90 as int)) as timestamp) as created_at",
        )

    def tenders(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey as id",
            "o_custkey % 25 as user_id",
            "o_custkey as company_id",
            "case when o_orderkey % 4 <> 0 then o_custkey * 3 + o_orderkey % 3 end as company_letterhead_id",
            "concat('Licitacion ', cast(o_orderkey as string)) as title",
            "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'publica' else 'privada' end as process_type",
            """case when o_orderkey % 13 = 0 then 'committed' when o_orderkey % 11 = 0 then 'sent_for_approval'
                    when o_orderstatus = 'O' then 'draft' when o_orderstatus = 'P' then 'analyzing' else 'ready' end as status""",
            "case when o_orderkey % 5 <> 0 then concat('bases/', cast(o_orderkey as string), '.pdf') end as bases_document_path",
            "case when o_orderkey % 7 <> 0 then concat('bases-', cast(o_orderkey as string), '.pdf') end as bases_document_original_name",
            """array(named_struct('label', 'Empresa seleccionada', 'checked', true),
                     named_struct('label', 'Regulaciones asignadas', 'checked', case when o_orderkey % 17 <> 0 then o_orderkey % 3 <> 0 end),
                     named_struct('label', 'Bases cargadas', 'checked', o_orderkey % 5 <> 0)) as checklist""",
            "cast(o_orderdate as timestamp) as created_at",
        )

    def regulations(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey as id",
            "p_partkey % 25 as user_id",
            "concat(p_name, ' ', cast(p_partkey as string)) as title",
            "element_at(array('mx', 'US', 'Co'), cast(p_size % 3 as int) + 1) as country_code",
            "element_at(array('federal', 'estatal', 'local', 'entidad'), cast(p_size % 4 as int) + 1) as scope",
            "case when p_size % 7 <> 0 then p_brand end as regulatory_body",
            "p_size % 5 <> 0 as is_active",
            "case when p_partkey % 9 <> 0 then concat('module2/', lower(p_type), '/', cast(p_partkey as string), '.pdf') end as source_pdf_path",
            "case when p_partkey % 2 = 0 then concat(p_name, '.pdf') else '' end as source_pdf_original_name",
            "cast(date_add(date'1998-01-15', cast(p_partkey % 200 as int)) as timestamp) as created_at",
        )

    def bridge(self) -> DataFrame:
        """Pairs of tender and regulation, dealt by tender: as many lines in a task whatever their total, and no other exchange by tender."""
        lines = self.table("lineitem")
        pairs = lines.selectExpr("l_orderkey as licitacion_id", "l_partkey as regulation_id")
        return pairs.repartition(1 + lines.count() // PART_LINES, "licitacion_id").distinct()

    def opinions(self) -> DataFrame:
        """Latest opinion per company, kind and result."""
        lines = self.table("lineitem").selectExpr(
            "l_orderkey", "cast(l_linenumber % 3 as bigint) as kind", "l_returnflag", "cast(l_shipdate as date) as shipped"
        )
        owners = self.table("orders").selectExpr("o_orderkey as l_orderkey", "o_custkey as company_id")
        # Lines are reduced to one row per order, kind and flag before they meet the orders.
        per_order = lines.groupBy("l_orderkey", "kind", "l_returnflag").agg(
            F.max("shipped").alias("shipped"), F.count(F.lit(1)).alias("n")
        )
        grouped = (
            per_order.join(owners, "l_orderkey")
            .groupBy("company_id", "kind", "l_returnflag")
            .agg(F.max("shipped").alias("shipped"), F.sum("n").alias("n"))
        )
        return grouped.selectExpr(
            "company_id * 9 + kind * 3 + instr('ARN', l_returnflag) - 1 as id",
            "company_id",
            "element_at(array('sat', 'infonavit', 'imss'), cast(kind as int) + 1) as tipo",
            "element_at(array('positivo', 'negativo', 'pendiente'), instr('ARN', l_returnflag)) as estado",
            "shipped as fecha_emision",
            "case when n % 3 <> 0 then date_add(shipped, cast(n % 45 as int)) end as fecha_vigencia",
        )

    def deeds(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id as id",
            "doc_id div 2 as company_id",
            "element_at(array('constitutiva', 'modificacion', 'poderes'), cast(doc_id % 3 as int) + 1) as tipo",
            "date_add(date'1997-01-01', cast(doc_id % 700 as int)) as fecha_registro",
            "case when doc_id % 10 <> 9 then concat('actas/', cast(doc_id as string), '.pdf') end as documento_path",
            "cast(date_add(date'1998-06-01', cast(doc_id % 60 as int)) as timestamp) as created_at",
            "cast(date_add(date'1998-06-02', cast(doc_id % 90 as int)) as timestamp) as updated_at",
        )

    def statements(self) -> DataFrame:
        return self.table("orders").where("o_orderstatus = 'F'").selectExpr(
            "o_orderkey as id",
            "o_custkey as company_id",
            "element_at(array('mensual', 'anual', 'otro'), cast(o_orderkey % 3 as int) + 1) as periodicity",
            "cast(1995 + o_orderkey % 110 as bigint) as year",
            "case when o_orderkey % 6 <> 0 then cast(o_orderkey % 14 as bigint) end as month",
            "case when o_orderkey % 8 <> 0 then o_orderkey % 2 = 0 end as is_audited",
            "concat('estado-', cast(o_orderkey as string), case when o_orderkey % 9 = 0 then '.doc' else '.pdf' end) as file_name",
            "cast(o_orderkey % 25000 as bigint) as file_kb",
        )

    def declarations(self) -> DataFrame:
        return self.table("orders").where("o_orderstatus = 'P'").selectExpr(
            "o_orderkey as id",
            "o_custkey as company_id",
            "element_at(array('mensual', 'anual'), cast(o_orderkey % 2 as int) + 1) as periodicity",
            "cast(1995 + o_orderkey % 10 as bigint) as year",
            "case when o_orderkey % 6 <> 0 then cast(1 + o_orderkey % 12 as bigint) end as month",
            """concat('decl.', cast(o_orderkey as string),
                      element_at(array('.pdf', '.XML', '.xlsx', '.Xls', '.csv', '.docx', ''), cast(o_orderkey % 7 as int) + 1)) as file_name""",
        )

    def validations(self) -> DataFrame:
        """Tenders past the open state have a validation."""
        return self.table("orders").where("o_orderstatus <> 'O'").selectExpr(
            "o_orderkey + 1000000 as id",
            "o_custkey % 25 as user_id",
            "o_orderkey as licitacion_id",
            "case when o_orderstatus = 'F' then 'ready_for_export' when o_orderpriority = '5-LOW' then 'draft' else 'reviewed' end as status",
            "element_at(array('green', 'yellow', 'red'), cast(o_orderkey % 3 as int) + 1) as traffic_light",
            "o_orderkey % 10 = 0 as override_applied",
            "case when o_orderkey % 10 = 0 then concat('motivo legal ', cast(o_orderkey as string)) end as override_reason",
            "cast(o_orderdate as timestamp) as created_at",
        )

    def findings(self) -> DataFrame:
        """Persisted findings: the settled order lines."""
        return (
            self.table("lineitem")
            .where("l_linestatus = 'F'")
            .groupBy("l_orderkey", "l_returnflag", "l_linenumber")
            .agg(F.count(F.lit(1)).alias("n"))
            .selectExpr(
                "l_orderkey * 100 + instr('ARN', l_returnflag) * 10 + l_linenumber as id",
                "l_orderkey + 1000000 as proposal_validation_id",
                "element_at(array('critical', 'warning', 'info'), instr('ARN', l_returnflag)) as severity",
                "case when l_returnflag = 'A' then 'cumplimiento' else 'seguimiento' end as category",
                "concat('R-', cast(l_linenumber as string)) as rule_code",
                "concat('Hallazgo x', cast(n as string)) as message",
                "case when l_linenumber % 2 = 0 then concat('Nota ', cast(l_linenumber as string)) end as resolution_note",
            )
        )

    def report_rows(self) -> DataFrame:
        """Messages held inside stored reports: structured findings and plain issue/warning messages."""
        return (
            self.table("lineitem")
            .where("l_linestatus = 'O'")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(F.count(F.lit(1)).alias("n"))
            .selectExpr(
                "l_orderkey + 1000000 as validation_id",
                "case when l_orderkey % 3 = 0 then 'structured' when l_linenumber % 2 = 0 then 'issue' else 'warning' end as kind",
                "cast(l_linenumber as bigint) as pos",
                "case when l_linenumber % 3 <> 0 then 'Cumplimiento general' end as documento",
                "case when l_linenumber % 4 <> 0 then 'Alta' end as gravedad",
                "concat('mensaje ', cast(l_linenumber as string), ' x', cast(n as string)) as error",
                "case when l_linenumber % 5 <> 0 then 'Corregir' end as propuesta_solucion",
            )
        )

    def document_index(self, with_text: bool = False) -> DataFrame:
        columns = [
            "doc_id as id",
            "element_at(array('acta', 'opinion', 'regulation'), cast(doc_id % 3 as int) + 1) as document_type",
            "element_at(array('Acta', 'OpinionCumplimiento', 'Regulation'), cast(doc_id % 3 as int) + 1) as documentable_type",
            "doc_id div 3 as documentable_id",
            "doc_id % 25 as user_id",
            "element_at(array('pending', 'processed', 'indexed', 'failed', 'processed'), cast(doc_id % 5 as int) + 1) as status",
            "concat('files/', cast(doc_id as string), '.pdf') as storage_path",
            "case when doc_id % 8 = 0 then 'error de texto' end as error_message",
            "timestampadd(HOUR, cast(doc_id % 72 as int), timestamp'1998-06-28 00:00:00') as created_at",
            "timestampadd(HOUR, cast(doc_id % 96 as int), timestamp'1998-06-28 12:00:00') as updated_at",
        ]
        if with_text:
            columns += [
                "case when doc_id % 5 not in (0, 3) then text end as extracted_text",
                "case when doc_id % 7 <> 0 and doc_id % 5 not in (0, 3) then text end as index_text",
            ]
        return self.table("documents").selectExpr(*columns)

    def audit_events(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id as id",
            "case when event_id % 19 <> 0 then user_id % 25 end as user_id",
            "concat('http.', event_type) as event_type",
            "element_at(array('Acta', 'Regulation', 'Licitacion'), cast(event_id % 3 as int) + 1) as entity_type",
            "user_id as entity_id",
            "element_at(array('GET', 'POST', 'PUT', 'DELETE', 'HEAD', 'OPTIONS'), cast(event_id % 6 as int) + 1) as request_method",
            "cast(200 + event_id % 4 * 100 as bigint) as status_code",
            """case when event_id % 2 = 0 then array('title', '_token', 'password') else array('k', 'current_password') end as payload_keys""",
            "props as metadata",
            "cast(ts as timestamp) as created_at",
        )

    def transition_requests(self) -> DataFrame:
        return self.table("events").selectExpr(
            "case when event_id % 29 = 0 then 'contract' when event_id % 3 = 0 then 'validation' else 'tender' end as entity_type",
            "user_id as entity_id",
            "event_id as seq",
            """case when event_id % 3 = 0
                    then case event_type when 'view' then 'reviewed' when 'click' then 'ready_for_export' when 'error' then 'draft' else 'archived' end
                    else case when event_type = 'view' then 'analyzing' when event_type = 'click' then 'ready' when event_type = 'signup' then 'draft'
                              when event_type = 'purchase' then 'sent_for_approval' when value < 20 then 'committed' else 'draft' end
               end as to_state""",
            "user_id",
            "concat('evento ', event_type) as reason",
        )

    def pages(self) -> DataFrame:
        """Conversation turns as page text, with scanner-like noise around the original words."""
        return self.table("conversations").select(
            F.col("conv_id").alias("doc_id"),
            (F.col("turn") + 1).alias("page_number"),
            F.expr(
                r"""concat(
                'ESCRITURA N~MERO ', cast(conv_id * 7 + turn as string), ' LIBRO ', cast(turn + 1 as string), '\r\n',
                '  Constituci~n de la sociedad - -- -  \n',
                'inscripci~n -- -- en el Registro P~blico\tde  comercio\r',
                '\n\n\n~~~ === ~~~\n',
                case when turn % 3 = 0 then '. - .\n' when turn % 3 = 1 then 'a1 ++ -- ##\n' else 'FOLIO MERCANTIL 12 NOTARIO\n' end,
                '   \n', text, ' —— -\n\n', '1 2 ** !!\n', 'x\n', text, '\n\n')"""
            ).alias("text"),
        )

    def page_variants(self) -> DataFrame:
        base = self.table("conversations").select(
            F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"), "turn", "text"
        )
        return base.select(
            "doc_id",
            "page_number",
            F.posexplode(
                F.array(
                    F.expr("case when turn % 2 = 0 then text else reverse(text) end"),
                    F.expr("concat('ESCRITURA NOTARIA 12 LIBRO 3\n', lower(text), ' Folio')"),
                    F.expr("concat('folio mercantil ', text, ' FECHA 12')"),
                )
            ).alias("variant", "text"),
        ).selectExpr("doc_id", "page_number", "cast(variant as bigint) as variant", "text")

    def deed_texts(self) -> DataFrame:
        """Document text below a header of labelled deed fields."""
        return self.table("documents").select(
            "doc_id",
            F.expr("element_at(array('acta', 'acta', 'opinion', 'regulation', 'otro'), cast(doc_id % 5 as int) + 1)").alias("document_type"),
            F.expr(
                r"""concat(
                case when doc_id % 9 = 0 then '' else concat(
                    'ESCRITURA NÚMERO: ', cast(doc_id * 3 + 100 as string), '/', cast(1990 + doc_id % 30 as string), '\n',
                    case when doc_id % 4 = 0 then 'Notaria No. 7;' else concat('NOTARÍA NÚMERO: ', cast(doc_id % 150 + 1 as string), ';') end, '\n',
                    'Notaría de Monterrey Nuevo León; 64000\n',
                    'Notario Público: Lic. Ana Pérez Núñez; 12\n',
                    'Folio Mercantil: ', cast(doc_id as string), '-', case when doc_id % 2 = 0 then '1*' else 'A' end, '\n',
                    'Registro Público de Comercio de Guadalajara Jalisco; ',
                    'Fecha de inscripción: ', cast(doc_id % 31 + 1 as string), '/', cast(doc_id % 12 + 1 as string), '/', cast(2000 + doc_id % 24 as string), '\n',
                    'Fecha de registro: ', cast(doc_id % 28 + 1 as string), '-', cast(doc_id % 12 + 1 as string), '-',
                        case when doc_id % 3 = 0 then lpad(cast(doc_id % 28 + 1 as string), 2, '0') else cast(1999 + doc_id % 20 as string) end, '\n',
                    'Acto: ', case when doc_id % 3 = 0 then 'Constitución de sociedad,' when doc_id % 3 = 1 then 'n/a'
                                   else 'reforma de estatutos; otorgamiento de poderes.' end, ' 9\n',
                    'Opinión ', case when doc_id % 2 = 0 then 'positiva' else 'NEGATIVA' end, case when doc_id % 7 = 0 then ' INFONAVIT' when doc_id % 7 = 1 then ' imss' else '' end, '\n',
                    'Fecha de emisión: 0', cast(doc_id % 9 + 1 as string), '/05/1998 Vigencia: 3', cast(doc_id % 2 as string), '/06/1998\n',
                    'Secretaría de Economía; 1\n') end,
                text)"""
            ).alias("text"),
        )

    def candidates(self, dealt: bool = False) -> DataFrame:
        """Extraction candidates: every document, four model sources, every field; values and gaps by a fixed rule."""
        fields = ", ".join(f"'{f}'" for f in DEED_FIELDS)
        rows = (
            (self.dealt_documents() if dealt else self.table("documents"))
            .select("doc_id", F.expr("posexplode(array('llm', 'llm_retry', 'vision', 'vision_first_page_2'))").alias("s", "source_key"))
            .select("*", F.expr(f"posexplode(array({fields}))").alias("f", "field"))
            .withColumn("h", F.expr("(doc_id * 31 + s * 7 + f * 13) % 11"))
        )
        return rows.selectExpr(
            "doc_id",
            "source_key",
            "case when s = 3 then 'vision_first' else source_key end as source",
            "cast(s + 1 as bigint) as stage_order",
            "field",
            """case when field in ('apoderados', 'participacion_accionaria', 'consejo_administracion', 'direccion_empresa') or h = 0 then null
                    when h = 1 then 'n/a' when h = 2 then ' ' when h = 3 then '7b'
                    when field in ('fecha_registro', 'rpc_fecha_inscripcion', 'fecha_inscripcion') then concat('2024-0', cast(h - 3 as string), '-11')
                    else concat('Valor ', cast(h % 4 as string)) end as value""",
            """case when h >= 4 and field = 'apoderados' then '[{"ine":"1","poder_documento":null,"nombre_completo":"Ana","facultades_otorgadas":"n/a"}]'
                    when h >= 5 and field = 'participacion_accionaria' then '[{"socio":"Eva","porcentaje":"50%"}]'
                    when h >= 6 and field in ('consejo_administracion', 'direccion_empresa') then '["Ana","Eva"]'
                    when field in ('apoderados', 'participacion_accionaria', 'consejo_administracion', 'direccion_empresa') then '[]' end as value_json""",
            "cast(case when s = 3 then 2 end as bigint) as page_number",
        )

    def decisions(self, dealt: bool = False) -> DataFrame:
        return (
            (self.dealt_documents() if dealt else self.table("documents"))
            .select("doc_id", F.expr("explode(array('acto', 'libro_numero', 'rpc_folio'))").alias("field"))
            .selectExpr(
                "doc_id",
                "field",
                "element_at(array('llm', 'vision', 'desconocida'), cast((doc_id + length(field)) % 3 as int) + 1) as source_key",
                "'revision manual' as reason",
            )
        )

    def vectors(self) -> DataFrame:
        """Vectors of deeds and opinions that share their numbers."""
        typed = self.table("embeddings").selectExpr("*", "case when vec_id % 3 = 0 then 'opinion' else 'acta' end as document_type")
        return typed.selectExpr(
            "concat('documents-', document_type) as namespace",
            "concat(document_type, '-', cast(label as string), '-', cast(vec_id as string)) as id",
            "cast(label as bigint) as doc_id",
            "document_type",
            "vec_id as chunk_index",
            "embedding as values",
            """case when vec_id % 10 = 0 then ' ' when vec_id % 10 = 1 then 'Resumen estructurado del acta x'
                    else concat('fragmento ', cast(vec_id % 37 as string)) end as text""",
        )
