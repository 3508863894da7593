"""Functions for users of SQL, in the session's own CREATE FUNCTION form: expanded into the plan, with no Python in it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as T


def _normal(c: str) -> str:
    for marked, plain in (T.MARKED_PAIRS | dict(zip("ѐѝЀЍ", "еиЕИ", strict=True))).items():
        c = f"replace({c}, '{marked}', '{plain}')"
    return f"translate(regexp_replace({c}, '[{T.ACUTE}{T.GRAVE}]', ''), '’ʼ`´', \"''''\")"


def _kind(c: str) -> str:
    return f"""CASE WHEN {c} RLIKE r"^{T._START}" THEN 'word' WHEN {c} RLIKE r"^[{T._LAT}]" THEN 'latin' WHEN {c} RLIKE '^[0-9]' THEN 'number'
        WHEN {c} RLIKE r"^{T.SPACE}" THEN 'space' ELSE 'punct' END"""


#: name: (parameters, what it returns, body). Later ones may call earlier ones.
FUNCTIONS = {
    "token_kind": ("piece STRING", "STRING", _kind("piece")),
    "normal_form": ("word STRING", "STRING", _normal("word")),
    "loose_key": ("word STRING", "STRING", r"""regexp_replace(translate(lower(normal_form(word)), 'ёѣіѳѵї', 'ееифии'), '([^аеиоуыэюяь])ъ$', '$1')"""),
    "collapse_space": ("txt STRING", "STRING", r"""trim(regexp_replace(txt, r"[\x{0009}-\x{000D} \x{00A0}\x{00AD}]+", ' '))"""),
    "tokens": (
        "txt STRING",
        "ARRAY<STRUCT<pos: INT, kind: STRING, surface: STRING>>",
        f"""filter(transform(regexp_extract_all(txt, r"{T.PIECE}", 0), (p, i) -> named_struct('pos', i, 'kind', {_kind("p")}, 'surface', p)), t -> t.kind <> 'space')""",
    ),
    "tokenize": ("txt STRING", "TABLE (pos INT, kind STRING, surface STRING)", "SELECT t.pos, t.kind, t.surface FROM (SELECT tokens(txt) AS found) LATERAL VIEW inline(found) t"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known in this session, again if they are; returns their names.

    The tokens of a table: SELECT doc_id, t.* FROM (SELECT doc_id, tokens(text) AS found FROM documents) LATERAL VIEW inline(found) t,
    which unnests each text inside its row. tokenize is the table function of one text, SELECT * FROM tokenize('...'); beside a table Spark would join it back
    by the text. An empty text has no tokens; null gives null, or no rows."""
    for name, (parameters, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return list(FUNCTIONS)
