"""Column -> Column functions.  All are built-in Spark expressions, so they
stay inside whole-stage codegen; none of them calls Python per row."""

from textlab.functions.hashing import hash_u32, hash_key, fraction_threshold, in_fraction  # noqa: F401
from textlab.functions.text import (  # noqa: F401
    text_length, contains_mention, replace_char, tokenize_text, extract_spans, mask_mentions,
)
from textlab.functions.arrays import (  # noqa: F401
    head_tail_window, add_special_tokens, pad_to_length, attention_mask, array_to_text,
)
from textlab.functions.mathfn import (  # noqa: F401
    softmax, argmax_class, log_sum_exp, cross_entropy, focal_term, class_weight, sigmoid_bce,
)
from textlab.functions.formats import (  # noqa: F401
    format_elapsed, report_slice, round_ratio_text, ratio_half_even,
)
