"""Extensions over unbounded tables."""
