from .clean import clean, post_text  # noqa: F401
from .text import (STAT_NAMES, char_count, digit_count, emoji_count,  # noqa: F401
                   fill_empty, is_empty, lexicon_tokens, na_to_null, nan_string,
                   sentence_count, stat_columns, stat_vector, url_count,
                   word_count, word_tokens)
