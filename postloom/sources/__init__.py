"""Readers for event files, post tables, user lists and lexicons."""

from postloom.sources.actions import read_actions_csv
from postloom.sources.catalogue import catalogue, list_files
from postloom.sources.checks import missing_columns, require_columns
from postloom.sources.dates import date_of_path, dates_of_files, with_ingest_date
from postloom.sources.firehose import read_firehose
from postloom.sources.lexicons import read_lexicon
from postloom.sources.posts import file_report, read_posts
from postloom.sources.users import read_user_list, read_users

__all__ = [
    "catalogue",
    "date_of_path",
    "dates_of_files",
    "file_report",
    "list_files",
    "missing_columns",
    "read_actions_csv",
    "read_firehose",
    "read_lexicon",
    "read_posts",
    "read_user_list",
    "read_users",
    "require_columns",
    "with_ingest_date",
]
