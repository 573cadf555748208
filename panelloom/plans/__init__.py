"""From descriptions to lazy plans: features, fitting, prediction, back-testing."""
