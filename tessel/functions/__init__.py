"""Column functions: text, similarity, lexicons, dialogs."""
