"""Column expressions. All take and return ``Column`` and stay inside the JVM where Spark has
the built-in; the few Arrow helpers only receive the values that need them."""

from .articles import (  # noqa: F401
    article_display, content_hash, detect_entity, extract_article_ref, mentions_unknown_entity,
    normalize_article, normalize_name, pick_enforcement_date, point_id, priority_scope,
    source_url,
)
from .judging import (  # noqa: F401
    coerce_verdict, failure_reason, infer_source, is_failure, next_action, source_of_event,
)
from .routing import (  # noqa: F401
    expand_terms, handler_of, law_label, route_question, search_term, short_tool, squeeze,
)
from .text import (  # noqa: F401
    article_forms, article_text, clean_text, collapse_space, flatten_text, json_field, nfc,
    number_paragraphs, preview, quality_score, reference_count, strip_markup, strip_space,
)
from .web import news_date, source_brand  # noqa: F401
