"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from ledgerloom.llm.alignment import op13_tokenizer_alignment
from ledgerloom.llm.divergence import OP12_SQL, op12_source_divergence
from ledgerloom.llm.language import op4_language_id
from ledgerloom.llm.minhash import op3_minhash_near_dedup
from ledgerloom.llm.packing import op2_best_fit_packing
from ledgerloom.llm.quality import op5_risk_controlled_rules
from ledgerloom.llm.quotes import OP1_SQL, op1_quotation_linking
from ledgerloom.llm.sepscan import op6_separator_scan
from ledgerloom.llm.simhash import op11_golay_simhash
from ledgerloom.llm.sstable import op10_sstable_output
from ledgerloom.llm.toxicity import op9_subsequence_kernel_toxicity
from ledgerloom.llm.warc import op8_content_addressed_warc
from ledgerloom.llm.winnowing import OP7_SQL, op7_winnowing_decontamination

QUERIES = {
    f.__name__: f
    for f in (
        op1_quotation_linking,
        op2_best_fit_packing,
        op3_minhash_near_dedup,
        op4_language_id,
        op5_risk_controlled_rules,
        op6_separator_scan,
        op7_winnowing_decontamination,
        op8_content_addressed_warc,
        op9_subsequence_kernel_toxicity,
        op10_sstable_output,
        op11_golay_simhash,
        op12_source_divergence,
        op13_tokenizer_alignment,
    )
}

ORACLES = {"op1_quotation_linking": OP1_SQL, "op7_winnowing_decontamination": OP7_SQL, "op12_source_divergence": OP12_SQL}
