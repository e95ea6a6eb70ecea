"""What is said in a session: message grammar, constraint state, session memory, simulated customers. Plain Python,
run by the operators over Arrow or pandas batches."""
