"""DataFrame operators."""

from postloom.operators.behavior import user_action_counts
from postloom.operators.classify import (
    TextLabelModels,
    annotate_text,
    load_text_models,
    merge_text_models,
    save_text_models,
    score_text_labels,
    text_labels_from_weights,
    train_text_label,
    train_text_labels,
)
from postloom.operators.composites import lexicon_composites
from postloom.operators.describe import describe_features
from postloom.operators.edges import english_posts, repost_edges
from postloom.operators.lexicon import (
    Lexicon,
    collect_lexicon,
    lexicon_counts,
    lexicon_counts_join,
    lexicon_features,
    lexicon_pattern,
    lexicon_vector,
)
from postloom.operators.linguistic import linguistic_features
from postloom.operators.ordering import order_by_time
from postloom.operators.posts import unique_posts, user_posts
from postloom.operators.reconcile import reconcile, reconcile_summary, unmatched_rows
from postloom.operators.sampling import sample_rows, sample_users

__all__ = [
    "Lexicon",
    "TextLabelModels",
    "annotate_text",
    "collect_lexicon",
    "describe_features",
    "english_posts",
    "lexicon_composites",
    "lexicon_counts",
    "lexicon_counts_join",
    "lexicon_features",
    "lexicon_pattern",
    "lexicon_vector",
    "linguistic_features",
    "load_text_models",
    "merge_text_models",
    "order_by_time",
    "reconcile",
    "reconcile_summary",
    "repost_edges",
    "sample_rows",
    "sample_users",
    "save_text_models",
    "score_text_labels",
    "text_labels_from_weights",
    "train_text_label",
    "train_text_labels",
    "unique_posts",
    "unmatched_rows",
    "user_action_counts",
    "user_posts",
]
