"""Plan-level building blocks: materialised stages and the calendar roll-up."""
