"""The registered queries of this package, and SQL for those that SQL can express."""

from .chat import OP12_SQL, op12_chat_format
from .decontaminate import OP10_SQL, op10_decontamination
from .divergence import OP13_SQL, op13_source_divergence
from .html_text import op6_html_text
from .infilling import OP11_SQL, op11_fill_in_middle
from .langid import op9_language_id
from .licenses import op4_license_scan
from .media import op5_avi_media
from .mixing import OP8_SQL, op8_source_mixing
from .quality import op3_quality_trees
from .secrets import op2_secret_scan
from .simhash import op7_simhash_dedup
from .substrings import op1_suffix_dedup

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_trees": op3_quality_trees,
    "op4_license_scan": op4_license_scan,
    "op5_avi_media": op5_avi_media,
    "op6_html_text": op6_html_text,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_chat_format": op12_chat_format,
    "op13_source_divergence": op13_source_divergence,
}

SQL = {"op8_source_mixing": OP8_SQL, "op10_decontamination": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_chat_format": OP12_SQL, "op13_source_divergence": OP13_SQL}
