"""Built-in phrase lists: ways to open a question, a request, or neither."""

PHRASES = {
    "openings::question": ["What", "Which", "Who", "Where", "When", "Why", "How", "How many", "How often", "Is it true that", "Could it be that", "In what way", "For what reason"],
    "openings::ask": [
        "Explain", "Describe", "List", "Name", "Compare", "Summarise", "Outline", "Show", "Tell me", "Give an example of", "Give reasons for", "Walk me through", "Help me understand", "Define",
        "Sketch", "Illustrate", "Contrast", "Rank", "Classify", "Group", "Estimate", "Calculate", "Work out", "Find", "Look up", "Check", "Verify", "Correct", "Rewrite", "Translate", "Shorten", "Expand",
        "Continue", "Complete", "Draft", "Write", "Compose", "Plan", "Suggest", "Recommend", "Propose", "Choose", "Decide", "Argue for",
    ],
    "openings::neutral": ["I would like to know", "I am curious about", "Let us talk about", "Here is a topic:", "Consider", "Think about", "On the subject of", "Regarding", "As for", "With respect to"],
}
