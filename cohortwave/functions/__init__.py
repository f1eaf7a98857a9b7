"""Column -> Column helpers, column-name selection and tail probabilities."""
