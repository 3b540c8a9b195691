"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from rallyframe.llm.decontaminate import op6_decontaminate
from rallyframe.llm.divergence import OP13_SQL, op13_divergence
from rallyframe.llm.infill import OP11_SQL, op11_infill
from rallyframe.llm.langid import op4_language
from rallyframe.llm.media import op7_media
from rallyframe.llm.mixing import op1_mixing
from rallyframe.llm.neardup import op5_neardup
from rallyframe.llm.pii import op9_pii
from rallyframe.llm.quality import op2_quality
from rallyframe.llm.simhash import op12_simhash
from rallyframe.llm.toxicity import op3_toxicity
from rallyframe.llm.urls import OP8_SQL, op8_urls
from rallyframe.llm.warc import op10_warc

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_language": op4_language,
    "op5_neardup": op5_neardup,
    "op6_decontaminate": op6_decontaminate,
    "op7_media": op7_media,
    "op8_urls": op8_urls,
    "op9_pii": op9_pii,
    "op10_warc": op10_warc,
    "op11_infill": op11_infill,
    "op12_simhash": op12_simhash,
    "op13_divergence": op13_divergence,
}
ORACLES = {"op8_urls": OP8_SQL, "op11_infill": OP11_SQL, "op13_divergence": OP13_SQL}
