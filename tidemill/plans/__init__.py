"""End-to-end plans: backfill, verification, training."""
