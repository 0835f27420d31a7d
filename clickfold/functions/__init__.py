"""Column expressions shared by the reports (all built-in Spark functions,
so they stay inside whole-stage codegen)."""

from clickfold.functions.channels import channel_group
from clickfold.functions.params import (
    event_param,
    session_engaged,
    session_id,
    session_id_concat,
)
from clickfold.functions.text import landing_page_title, money_text

__all__ = [
    "channel_group", "event_param", "landing_page_title", "money_text",
    "session_engaged", "session_id", "session_id_concat",
]
