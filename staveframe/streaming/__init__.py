"""Extensions on Structured Streaming; the batch operators don't need them."""
