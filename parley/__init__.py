"""parley: chat-bot conversation analytics on Spark.

Decode bot/user JSON messages, flatten them to a wide message table, append
them to Parquet (batch or Structured Streaming), and roll them up into
engagement measures over six calendar grains with trends.

Every operator is a DataFrame -> DataFrame function built from Spark SQL
expressions; nothing runs in Python per row.
"""

from parley.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
