"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontamination, html_extract, language, line_dedup, mixing, quality, simhash, vptree, warc

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_decontaminate": decontamination.op2_decontaminate,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_warc_revisits": warc.op4_warc_revisits,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_html_text": html_extract.op6_html_text,
    "op7_quality": quality.op7_quality,
    "op8_simhash": simhash.op8_simhash,
    "op9_language": language.op9_language,
    "op10_nearest": vptree.op10_nearest,
}
SQL = {k: v for m in (chat, line_dedup, vptree, warc) for k, v in m.SQL.items()}
