"""Reading corpora and plan logs; writing reports."""
