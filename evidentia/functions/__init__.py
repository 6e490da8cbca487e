"""Column functions: text, metrics, rewards and prompts."""
